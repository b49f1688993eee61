"""Queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from stabilis.llm import bpe, exactdedup, isomedia, langid, lpf, mixing, phrases, resampling, secrets, simhash, toxicity, tput, urltree
from stabilis.llm.common import held_out, table


def op8_exact_dedup(spark, sf_dir):
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_iso_media(spark, sf_dir):
    return isomedia.stored_texts(table(spark, sf_dir, "documents"))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = langid.fit(docs.filter(~docs["held_out"]))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id").alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = toxicity.fit(docs.filter(~docs["held_out"]), labels)
    return toxicity.classify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_repeats(spark, sf_dir):
    return lpf.removal_digest(table(spark, sf_dir, "documents"))


def op4_url_filters(spark, sf_dir):
    return urltree.url_verdicts(table(spark, sf_dir, "pages"), shapes=True).withColumn("risk", F.round("risk", 6))


def op11_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark, sf_dir):
    return tput.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark, sf_dir):
    return phrases.removal_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op8_exact_dedup": op8_exact_dedup,
    "op10_bpe": op10_bpe,
    "op4_url_filters": op4_url_filters,
    "op3_repeats": op3_repeats,
    "op6_secrets": op6_secrets,
    "op2_mixing": op2_mixing,
    "op9_simhash": op9_simhash,
    "op7_toxicity": op7_toxicity,
    "op1_language_id": op1_language_id,
    "op5_iso_media": op5_iso_media,
    "op11_resampling": op11_resampling,
    "op12_ranked_search": op12_ranked_search,
    "op13_phrases": op13_phrases,
}



def _secret_sql() -> str:
    """Positions from splitting at each pattern, then a self-join within ``SCOPE`` characters for weak parts."""
    kinds, ctes, parts = list(secrets.KINDS), [], []
    for k, kind in enumerate(kinds):
        pattern = secrets.KINDS[kind][0].replace("'", "''")
        value = f"regexp_extract_all(x, '{pattern}', 2)" if kind == "assign" else "NULL::VARCHAR[]"
        ctes.append(f"""m{k} AS (SELECT uid, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM
            (SELECT uid, regexp_extract_all(x, '{pattern}') AS m, {value} AS v, string_split_regex(x, '{pattern}') AS g FROM t WHERE regexp_matches(x, '{pattern}')))""")
        keep = {
            "assign": "length(v[i]) >= 12",
            "key_id": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND NOT starts_with(m[i], 'AKIA') AND length(m[i]) < 40",
            "key": "length(m[i]) = 40",
        }.get(kind, "true")
        start = "list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0)"
        parts.append(f"SELECT uid, {k} AS ord, '{kind}' AS kind, '{secrets.KINDS[kind][1]}' AS class, CAST({start} AS BIGINT) AS a, CAST({start} + length(m[i]) AS BIGINT) AS b FROM m{k} WHERE {keep}")
    strong = len(secrets.STRONG)
    needs = " OR ".join(
        f"(w.kind = '{kind}' AND " + " AND ".join(f"EXISTS (SELECT 1 FROM p q WHERE q.uid = w.uid AND q.class = '{c}' AND abs(q.a - w.a) <= {secrets.SCOPE})" for c in classes) + ")"
        for kind, classes in secrets.NEEDS.items()
    )
    return f"""WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS x FROM documents), {', '.join(ctes)},
        p0 AS ({' UNION ALL '.join(parts)}),
        p AS (SELECT * FROM p0 w WHERE ord < {strong} OR NOT EXISTS (SELECT 1 FROM p0 q WHERE q.uid = w.uid AND q.ord < {strong} AND q.a < w.b AND w.a < q.b)),
        s AS (SELECT * FROM p w WHERE ord < {strong} OR {needs}),
        o AS (SELECT uid, count(*) FILTER (WHERE ord = 0) AS n0, count(*) FILTER (WHERE ord = 1) AS n1, count(*) FILTER (WHERE ord = 2) AS n2,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (WHERE ord < {strong}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM s GROUP BY uid)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (uid)"""


def _url_sql() -> str:
    """The same tree, level by level, in grouped SQL."""
    rules = sorted(urltree.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda col: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v if col == 'v' else h + p}'" for v, h, p in rules) + " END"
    depth = urltree.DEPTH
    ctes = [
        r"""u AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS e FROM pages)""",
        "r0 AS (SELECT page_id, translate(coalesce(e.h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(e.p, '') AS path FROM u)",
        f"r AS (SELECT *, {case('v')} AS fit, {case('r')} AS rule FROM r0)",
        "d AS (SELECT host, path, count(*) AS n, count(*) FILTER (WHERE fit = 'block') AS blocked, count(fit) AS labelled, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM r GROUP BY host, path)",
        f"l0 AS (SELECT host, path, n, blocked, labelled, CASE WHEN len(s) > {depth} THEN list_append(s[1:{depth}], array_to_string(s[{depth + 1}:], '/')) ELSE s END AS segs, '' AS template FROM d)",
    ]
    variable = urltree.VARIABLE
    for k in range(depth + 1):
        ctes += [
            f"s{k} AS (SELECT *, CASE WHEN regexp_matches(segs[{k + 1}], '{variable}') THEN '*' ELSE segs[{k + 1}] END AS seg FROM l{k})",
            f"k{k} AS (SELECT host, template, seg, sum(n) AS n FROM s{k} WHERE seg IS NOT NULL AND seg <> '*' GROUP BY ALL)",
            f"o{k} AS (SELECT host, template, true AS open FROM k{k} GROUP BY host, template HAVING count(*) >= {urltree.CHILDREN} AND sum(n) <= {urltree.ROWS_EACH} * count(*))",
            f"""l{k + 1} AS (SELECT host, path, n, blocked, labelled, segs, CASE WHEN seg IS NULL THEN template ELSE template || '/' || CASE WHEN open THEN '*' ELSE seg END END AS template
                FROM s{k} LEFT JOIN o{k} USING (host, template))""",
        ]
    ctes += [
        f"pl AS (SELECT host, path, blocked, labelled, CASE WHEN template = '' THEN '/' ELSE template END AS template FROM l{depth + 1})",
        "ls AS (SELECT *, regexp_extract(path, '([^/]*)/?$', 1) AS last FROM pl)",
        r"lt AS (SELECT *, regexp_extract(last, '^(.*?)(?:\.[A-Za-z0-9]{1,5})?$', 1) AS stem FROM ls)",
        """kd AS (SELECT host, template, concat_ws('|', CASE WHEN regexp_matches(stem, '^[0-9]*$') THEN 'd' WHEN regexp_matches(stem, '^[0-9a-f]*$') THEN 'x' WHEN regexp_matches(stem, '^[^0-9]*$') THEN 'a' ELSE 'm' END,
            length(stem)::VARCHAR, substr(last, length(stem) + 1, 9), (path LIKE '%/')::VARCHAR) AS kind, count(*) AS x, sum(blocked) AS blocked, sum(labelled) AS labelled FROM lt GROUP BY ALL)""",
        f"f{depth + 1} AS (SELECT host, template, sum(blocked) AS blocked, sum(labelled) AS labelled, template AS node FROM kd GROUP BY host, template)",
    ]
    for k in reversed(range(depth + 1)):
        literal = rf"^((?:/[^/]+){{{k}}})/[^/*][^/]*"
        named = lambda mark, literal=literal: rf"regexp_replace(node, '{literal}', '\1/{mark}')"
        ctes += [
            f"h{k} AS (SELECT * FROM f{k + 1} WHERE regexp_matches(node, '{literal}'))",
            f"hi{k} AS (SELECT host, node, kind, sum(kd.x) AS x FROM kd JOIN (SELECT host, template, node FROM h{k}) USING (host, template) GROUP BY ALL)",
            f"""no{k} AS (SELECT host, node, {named('*')} AS parent, b, t, nx, kx FROM (SELECT host, node, sum(blocked) AS b, sum(labelled) AS t FROM h{k} GROUP BY ALL)
                JOIN (SELECT host, node, sum(x) AS nx, count(*) AS kx FROM hi{k} GROUP BY ALL) USING (host, node))""",
            f"po{k} AS (SELECT host, parent, sum(b) / sum(t)::DOUBLE AS rate FROM no{k} WHERE t > 0 GROUP BY ALL)",
            f"""kn{k} AS (SELECT host, parent, node, CASE WHEN z > 2 THEN '*+' WHEN z < -2 THEN '*-' ELSE '*' END AS mark FROM
                (SELECT host, parent, node, coalesce((b - t * rate) / nullif(sqrt(t * rate * (1 - rate)), 0), 0.0) AS z FROM no{k} JOIN po{k} USING (host, parent) WHERE t > 0))""",
            f"cl{k} AS (SELECT host, parent, mark, kind, sum(x) AS y FROM kn{k} JOIN hi{k} USING (host, node) GROUP BY ALL)",
            f"to{k} AS (SELECT host, parent, mark, sum(y) AS ny, count(*) AS ky FROM cl{k} GROUP BY ALL)",
            f"""pa{k} AS (SELECT host, parent, node, mark, nx, ny, kx, ky, ny / nx::DOUBLE AS ratio, x, coalesce(y, 0) AS y, y IS NOT NULL AS hit FROM (SELECT * FROM no{k} WHERE t = 0)
                JOIN to{k} USING (host, parent) JOIN hi{k} USING (host, node) LEFT JOIN cl{k} USING (host, parent, mark, kind))""",
            f"""ch{k} AS (SELECT host, parent, node, mark, sum((sqrt(ratio) * x - y / sqrt(ratio)) ** 2 / (x + y)) + (ny - sum(y)) / ratio AS chi, kx + ky - count(*) FILTER (WHERE hit) - 1 AS free
                FROM pa{k} GROUP BY host, parent, node, mark, nx, ny, kx, ky, ratio)""",
            f"ne{k} AS (SELECT *, round(chi - free - 2 * sqrt(2.0 * free), 9) AS gap FROM ch{k})",
            f"""me{k} AS (SELECT host, parent, node, mark FROM kn{k} UNION ALL
                SELECT host, parent, node, mark FROM (SELECT *, row_number() OVER (PARTITION BY host, parent, node ORDER BY gap, mark) AS n FROM ne{k} WHERE gap <= 0) WHERE n = 1)""",
            f"in{k} AS (SELECT host, node, mark FROM me{k} JOIN (SELECT host, parent, mark FROM me{k} GROUP BY ALL HAVING count(*) > 1) USING (host, parent, mark))",
            f"""f{k} AS (SELECT host, template, blocked, labelled, CASE WHEN mark IS NULL THEN node WHEN mark = '*' THEN {named('*')} WHEN mark = '*+' THEN {named('*+')} ELSE {named('*-')} END AS node
                FROM f{k + 1} LEFT JOIN in{k} USING (host, node))""",
        ]
    ctes += [
        "g AS (SELECT host, template, blocked, labelled, node AS merged FROM f0)",
        f"ri AS (SELECT host, merged, (sum(blocked) + {urltree.STRENGTH * urltree.PRIOR}::DOUBLE) / (sum(labelled) + {urltree.STRENGTH}::DOUBLE) AS risk FROM g GROUP BY ALL)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + f"""
        SELECT page_id, r.host, r.path, rule, coalesce(fit, CASE WHEN risk >= {urltree.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, g.merged AS template, round(risk, 6) AS risk
        FROM r JOIN pl ON r.host = pl.host AND r.path = pl.path JOIN g ON pl.host = g.host AND pl.template = g.template JOIN ri ON g.host = ri.host AND g.merged = ri.merged"""
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _resampling_sql() -> str:
    """CRC-32 bit by bit in a table made by rule, then byte by byte over each distinct feature."""
    b = resampling.BUCKETS
    grams = lambda name: f"""SELECT uid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM {name}"""  # noqa: E731
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {words} AS w FROM documents),
        q AS (SELECT row_number() OVER () AS uid, {words} AS w FROM benchmark),
        df AS ({grams('d')}), qf AS ({grams('q')}),
        crc AS (SELECT list(v ORDER BY n) AS c FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n))),
        e AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM qf)),
        y AS (SELECT f, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT) AS bytes FROM e),
        k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, z: xor(a >> 8, c[(xor(a, z) & 255) + 1])), 4294967295) % {b} AS bucket FROM y, crc),
        s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM qf JOIN k USING (f) GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {b}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM qf) + {b})))) AS BIGINT) AS gain
            FROM (SELECT n AS bucket FROM range({b}) r(n)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        w AS (SELECT uid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY uid),
        h AS (SELECT uid, doc_id, len(w) AS n_words, ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
        o AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN w USING (uid)),
        r AS (SELECT *, n_words >= {resampling.LEAST_WORDS} AS fits, row_number() OVER (PARTITION BY n_words >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS n FROM o)
        SELECT doc_id, n_features, weight, score, CASE WHEN fits AND n <= {resampling.PERCENT} * (SELECT count(*) FROM r WHERE fits) // 100 THEN n END AS rank FROM r"""


def _search_sql() -> str:
    """All scores of all pairs that share a term."""
    words = lambda name: f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM {name}"
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {words('documents')}),
        q AS (SELECT row_number() OVER () AS qid, item_id, {words('benchmark')}),
        z AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
        p AS (SELECT uid, doc_id, 100 - 90 + (90 * len(w) * n) // l AS m, unnest(w) AS term FROM d, z WHERE len(w) > 0),
        f AS (SELECT uid, doc_id, m, term, count(*) AS tf FROM p GROUP BY ALL),
        i AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, z GROUP BY term, n),
        s AS (SELECT qid, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM (SELECT DISTINCT qid, item_id, unnest(w) AS term FROM q) JOIN i USING (term) JOIN f USING (term) GROUP BY qid, item_id, uid, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {tput.TOP}"""


def _phrases_sql() -> str:
    """All windows as text, and the first place of each."""
    n = phrases.LENGTH
    return f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS uid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        v AS (SELECT uid, unnest(range(1, len(w) - {n - 2})) AS a, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM d WHERE len(w) >= {n}),
        f AS (SELECT phrase, min((uid, a)) AS first FROM v GROUP BY phrase),
        c AS (SELECT DISTINCT uid, unnest(range(a, a + {n})) AS k FROM v JOIN f USING (phrase) WHERE (uid, a) <> first),
        x AS (SELECT uid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
        y AS (SELECT uid, count(*) AS kept, string_agg(word, ' ' ORDER BY k) AS rest FROM x ANTI JOIN c USING (uid, k) GROUP BY uid)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN y USING (uid)"""


ORACLE_SQL = {
    "op11_resampling": _resampling_sql(),
    "op12_ranked_search": _search_sql(),
    "op13_phrases": _phrases_sql(),
    "op4_url_filters": _url_sql(),
    "op6_secrets": _secret_sql(),
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
        ), g AS (
            SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
        FROM t JOIN g USING (content)
    """,
}
