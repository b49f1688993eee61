"""SQL for DuckDB that gives the rows of the catalogue's queries."""

from __future__ import annotations

from stabilis.operators.contextual import NEIGHBOUR, WIDTH
from stabilis.operators.stability import MIX, REPLICATE_STEP, SLOT_STEP
from stabilis.sources.tables import COMPONENTS, KEYS

KEY = ", ".join(KEYS)
WORD, TERM = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]{2,}"


def _words(text: str, pattern: str = WORD) -> str:
    return f"regexp_extract_all(lower({text}), '{pattern}')"


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _sentences(text: str) -> str:
    pieces = rf"string_split(regexp_replace(coalesce({text}, ''), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda x: {_stripped('x')}), lambda x: x <> '')"


def _grams(text: str, n: int) -> str:
    one = f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))"
    return f"flatten(list_transform(list_transform({_sentences(text)}, lambda s: {_words('s')}), lambda w: {one}))"


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _mattr(tokens: str, window: int = 25) -> str:
    n = f"len({tokens})"
    mean = f"list_sum(list_transform(range(1, {n} - {window} + 2), lambda i: len(list_distinct({tokens}[i:i+{window - 1}])))) / (({n} - {window - 1}) * {window}.0::DOUBLE)"
    return f"CASE WHEN {n} = 0 THEN 0.0 WHEN {n} <= {window} THEN len(list_distinct({tokens})) / {n}::DOUBLE ELSE {mean} END"


def _cosine_terms(terms: str, name: str) -> list[str]:
    """CTEs that end in ``name`` (keys, tfidf) from pairs with list columns {terms}_1 and {terms}_2."""
    return [
        f"{name}_t AS (SELECT {KEY}, unnest({terms}_1) AS term, 1 AS a, 0 AS b FROM lp UNION ALL SELECT {KEY}, unnest({terms}_2), 0, 1 FROM lp)",
        f"{name}_c AS (SELECT {KEY}, term, sum(a) AS a, sum(b) AS b FROM {name}_t GROUP BY ALL)",
        f"{name}_w AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1 + ln(1.5) END AS idf FROM {name}_c)",
        f"""{name} AS (SELECT {KEY}, CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 0.0 ELSE sum(a * idf * b * idf) / (sqrt(sum((a * idf) ** 2)) * sqrt(sum((b * idf) ** 2))) END AS tfidf
            FROM {name}_w GROUP BY {KEY})""",
    ]


def _divergence(grams: str, name: str) -> list[str]:
    return [
        f"{name}_t AS (SELECT {KEY}, unnest({grams}_1) AS term, 1 AS a, 0 AS b FROM lp UNION ALL SELECT {KEY}, unnest({grams}_2), 0, 1 FROM lp)",
        f"{name}_c AS (SELECT {KEY}, term, sum(a) AS a, sum(b) AS b FROM {name}_t GROUP BY ALL)",
        f"{name}_n AS (SELECT *, sum(a) OVER g AS na, sum(b) OVER g AS nb, count(*) OVER g AS v FROM {name}_c WINDOW g AS (PARTITION BY {KEY}))",
        f"{name}_p AS (SELECT {KEY}, na, nb, (a + 1e-9) / (na + 1e-9 * v) AS p, (b + 1e-9) / (nb + 1e-9 * v) AS q FROM {name}_n)",
        f"""{name} AS (SELECT {KEY}, CASE WHEN min(least(na, nb)) = 0 THEN 1.0
            ELSE greatest(0.0, least(1.0, sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2))) END AS {name} FROM {name}_p GROUP BY {KEY})""",
    ]


def _structure(base: list[str], paired, q) -> dict[str, str]:
    """Hashed tokens, depths by recursion, the 42 features and their similarity."""
    from stabilis.operators import structure as S
    from stabilis.plans.tokens import RELATIONS, TAGS

    draw = lambda what: _hash(repr(what), "rid", "sentence_id", "t", "text")
    listed = lambda names: "[" + ", ".join(map(repr, names)) + "]"
    tags = lambda names: "(" + ", ".join(map(repr, names)) + ")"
    name = lambda r: r.replace(":", "_")
    ctes = [
        *base,
        f"st AS (SELECT rid, unnest(range(1, len(ss) + 1)) AS sentence_id, unnest(ss) AS sentence FROM (SELECT concat_ws('/', essay_file, prompt, response_index) AS rid, {_sentences('response')} AS ss FROM responses))",
        f"wd AS (SELECT rid, sentence_id, unnest(range(0, len(ws))) AS t, unnest(ws) AS text FROM (SELECT rid, sentence_id, {_words('sentence')} AS ws FROM st))",
        f"""tk AS (SELECT rid, sentence_id, t + 1 AS token_id, {listed(TAGS)}[{draw('u')} % {len(TAGS)} + 1] AS upos, {listed(RELATIONS)}[{draw('r')} % {len(RELATIONS)} + 1] AS rel,
            CASE WHEN t > 0 THEN {draw('h')} % t + 1 END AS head FROM wd)""",
        "kt AS (SELECT * FROM tk WHERE upos <> 'PUNCT')",
        """dp AS (SELECT k.rid, k.sentence_id, k.token_id, CASE WHEN k.head IS NULL THEN 0 ELSE 1 END AS depth FROM kt k LEFT JOIN kt h ON h.rid = k.rid AND h.sentence_id = k.sentence_id AND h.token_id = k.head WHERE h.token_id IS NULL
            UNION ALL SELECT k.rid, k.sentence_id, k.token_id, d.depth + 1 FROM kt k JOIN dp d ON k.rid = d.rid AND k.sentence_id = d.sentence_id AND k.head = d.token_id)""",
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE rel = '{r}') AS {name(r)}" for r in (*S.PER_SENTENCE, *S.PER_NOUN, "advmod", *S.PER_VERB))
    ctes += [
        f"""fs AS (SELECT rid, {counts}, count(DISTINCT sentence_id) AS sentences, count(*) AS tokens, count(*) FILTER (WHERE upos IN {tags(S.NOUNS)}) AS nouns, count(*) FILTER (WHERE upos IN {tags(S.MODIFIED)}) AS modified,
            count(*) FILTER (WHERE upos IN {tags(S.VERBS)}) AS verbs, sum(depth) AS total_token_depth, max(depth) AS maximum_dependency_depth_total, coalesce(sum(abs(token_id - head)), 0) AS total_dependency_distance,
            coalesce(max(abs(token_id - head)), 0) AS maximum_dependency_distance_total, count(head) AS distances, count(*) FILTER (WHERE abs(token_id - head) >= 5) AS long_dependencies_ge_5 FROM kt JOIN dp USING (rid, sentence_id, token_id) GROUP BY rid)""",
        f"fe AS (SELECT *, {' + '.join(name(r) for r in S.PER_SENTENCE)} AS embedded_clausal_nodes FROM fs)",
    ]
    per = lambda a, b: f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0.0)"
    rates = (
        [per(name(r), "sentences") for r in S.PER_SENTENCE] + [per(name(r), "nouns") for r in S.PER_NOUN] + [per("advmod", "modified")] + [per(name(r), "verbs") for r in S.PER_VERB]
        + [per("total_token_depth", "tokens"), per("embedded_clausal_nodes", "sentences"), "maximum_dependency_depth_total::DOUBLE", per("total_dependency_distance", "distances"), "maximum_dependency_distance_total::DOUBLE", per("long_dependencies_ge_5", "distances")]
    )
    ctes.append(f"ft AS (SELECT rid, {', '.join(f'{r} AS {n}' for r, n in zip(rates, S.RATES))}, {', '.join(f'{t}::DOUBLE AS {t}' for t in S.TOTALS)}, sentences, tokens, nouns, verbs FROM fe)")
    names = [*S.RATES, *S.TOTALS]
    out = {"ctes": ctes, "structure_features": q(ctes, f"SELECT rid, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, sentences, tokens, nouns, verbs FROM ft").replace("WITH r0", "WITH RECURSIVE r0", 1)}
    alike = lambda n: f"coalesce(1 - abs({n}_1 - {n}_2) / nullif(greatest(abs({n}_1), abs({n}_2)), 0), 1.0)"
    mean = lambda group: f"({' + '.join(map(alike, group))}) / {len(group)}"
    ctes += [
        f"fk AS (SELECT essay_file, prompt, response_index, {', '.join(f'coalesce({n}, 0.0) AS {n}' for n in names)} FROM responses LEFT JOIN ft ON rid = concat_ws('/', essay_file, prompt, response_index))",
        paired(*names, of="fk", name="fp"),
        f"sm AS (SELECT {KEY}, {mean(S.RATES)} AS n, {mean(S.TOTALS)} AS t FROM fp)",
    ]
    out["ctes"] = ctes
    out["structure_similarity"] = q(ctes, f"SELECT {KEY}, round(n, 6) AS normalized, round(t, 6) AS total, round((n + t) / 2, 6) AS struct FROM sm").replace("WITH r0", "WITH RECURSIVE r0", 1)
    return out


def _mtld(tokens: str, name: str) -> str:
    """A CTE (doc_id, n, the number of words per factor) from ``words`` (doc_id, w): a fold over the words in order."""
    state = lambda types, size, factors: f"{{'word': '', 'types': {types}, 'size': {size}, 'factors': {factors}}}"
    start = state("[]::VARCHAR[]", "0::BIGINT", "0::BIGINT")
    seen = "list_contains(acc.types, el.word)"
    step = f"""CASE WHEN (len(acc.types) + (NOT {seen})::INT) / (acc.size + 1)::DOUBLE <= 0.72::DOUBLE THEN {state("[]::VARCHAR[]", "0::BIGINT", "acc.factors + 1")}
        ELSE {state(f"CASE WHEN {seen} THEN acc.types ELSE list_append(acc.types, el.word) END", "acc.size + 1", "acc.factors")} END"""
    items = f"list_transform({tokens}, lambda word: {{'word': word, 'types': []::VARCHAR[], 'size': 0::BIGINT, 'factors': 0::BIGINT}})"
    total = "(z.factors + CASE WHEN z.size > 0 THEN (1 - len(z.types) / z.size::DOUBLE) / (1 - 0.72::DOUBLE) ELSE 0.0 END)"
    return f"""{name} AS (SELECT doc_id, n, CASE WHEN {total} = 0 THEN n::DOUBLE ELSE n / {total} END AS per FROM
        (SELECT doc_id, len(w) AS n, list_reduce({items}, lambda acc, el: {step}, {start}) AS z FROM words))"""


def _hotelling(shift: list[str], q) -> str:
    """The quadratic form of mean and inverse covariance by elimination: rows and columns 0 to 3 are the covariance,
    4 is the mean; when the first four are eliminated, the last corner is minus the form."""
    p = len(COMPONENTS)
    up = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]

    def first(i: int, j: int) -> str:
        if i == p:
            return "0.0::DOUBLE"
        return f"avg(delta_{COMPONENTS[i]})" if j == p else f"covar_samp(delta_{COMPONENTS[i]}, delta_{COMPONENTS[j]})"

    ctes = [f"g0 AS (SELECT count(*) AS n, {', '.join(f'{first(i, j)} AS x{i}{j}' for i, j in up)} FROM sh WHERE magnitude IS NOT NULL)"]
    for k in range(p):
        kept = ", ".join(f"x{i}{j} - x{k}{i} * x{k}{j} / x{k}{k} AS x{i}{j}" for i, j in up if i > k)
        ctes.append(f"g{k + 1} AS (SELECT n, {kept} FROM g{k})")
    ctes.append(f"g AS (SELECT n, -n * x{p}{p} AS t2, (n - {p}) / ({p}.0::DOUBLE * (n - 1)) * (-n * x{p}{p}) AS f, n - {p} AS df2 FROM g{p})")
    tail = f"df2 / (df2 + {p} * f)"
    return q(
        [*shift, *ctes],
        f"""SELECT 'available' AS status, n AS essays, round(t2, 6) AS t2, round(f, 6) AS f, {p}::INT AS df1, df2::INT AS df2, round(({tail}) ** (df2 / 2.0) * (1 + df2 / 2.0 * (1 - {tail})), 6) AS p FROM g""",
    )


def _flat(text: str) -> str:
    flat = _stripped(rf"regexp_replace({text}, '\s+', ' ', 'g')")
    return rf"list_filter(string_split(regexp_replace({flat}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_stripped('x')} <> '')"


def _texts() -> dict[str, str]:
    """SQL of the queries over parts of texts, from the plain columns."""
    paras = rf"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: {_stripped('x')}), lambda x: x <> '')"
    one = f"pa AS (SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS p, unnest(ps) AS paragraph FROM (SELECT doc_id, {paras} AS ps FROM documents))"
    orders = "[[1, 2, 3, 4, 5, 6, 7, 8], [8, 2, 3, 4, 5, 6, 7, 1], [2, 1, 4, 3, 6, 5, 8, 7], [8, 7, 6, 5, 4, 3, 2, 1]]"
    fields = [_stripped(c) for c in ("lang", "source", "text")]
    body = {"I": "doc_id", "II": "lang", "III": "source", "IV": "n_chars"}
    held = ", ".join(f"coalesce({c}::VARCHAR, 'none') AS \"{n}\"" for n, c in body.items())
    places = [("I", "II"), ("I", "III"), ("II", "III"), ("I", "IV"), ("II", "IV"), ("III", "IV")]
    dot = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
    cos = lambda x, y: f"{dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"
    four = ", ".join(f"{cos(f'{x}.embedding', f'{y}.embedding')} AS {x}{y}" for x in "ab" for y in "cd")
    scaled = lambda x: f"round(({x} - 0.25) / 0.75, 6)"
    return {
        "mtld": f"""WITH words AS (SELECT doc_id, coalesce({_words('text')}, []) AS w FROM documents), {_mtld('w', 'ahead')}, {_mtld('list_reverse(w)', 'back')}
            SELECT doc_id, round(CASE WHEN ahead.n = 0 THEN 0.0 ELSE (ahead.per + back.per) / 2 END, 6) AS mtld FROM ahead JOIN back USING (doc_id)""",
        "paragraphs": f"WITH {one} SELECT * FROM pa",
        "flat_sentences": f"SELECT doc_id, CAST(unnest(range(len(fs))) AS INTEGER) AS s, unnest(fs) AS sentence FROM (SELECT doc_id, {_flat("coalesce(text, '')")} AS fs FROM documents)",
        "validation_edits": f"""WITH {one}, fl AS (SELECT doc_id, p, {_flat('paragraph')} AS fs FROM pa),
            ch AS (SELECT doc_id, fs[1:8] AS fs, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', 0, doc_id, p)), p) AS rk FROM fl WHERE len(fs) >= 8),
            tu AS (SELECT doc_id, fs, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 + 1 AS INTEGER) AS turn FROM ch WHERE rk = 1)
            SELECT doc_id, ['keep_same', 'intro_conc_swap', 'adjacent_swap', 'reverse'][turn] AS edit, array_to_string(fs, ' ') AS original,
            array_to_string(list_transform({orders}[turn], lambda i: fs[i]), ' ') AS edited FROM tu""",
        "cleaned_answers": f"SELECT conv_id, turn, {_stripped('text')} AS answer FROM conversations",
        "flattened_answers": f"""SELECT doc_id, CASE WHEN lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL
            THEN array_to_string(list_filter([{', '.join(fields)}], lambda x: x <> ''), chr(10) || chr(10)) END AS answer FROM documents""",
        "short_names": """SELECT doc_id, CASE WHEN len(parts) > 2 THEN array_to_string(parts[3:], '_') ELSE stem END AS name, printf('%.6f', n_chars / 8::DOUBLE) AS shown
            FROM (SELECT *, string_split(stem, '_') AS parts FROM (SELECT *, concat_ws('_', lang, 'set', source, doc_id || '.x') AS stem FROM documents))""",
        "section_pairs": f"WITH se AS (SELECT doc_id, {held} FROM documents)\n"
        + " UNION ALL ".join(f"""SELECT doc_id, '{a}' AS section_1, "{a}" AS body_1, '{b}' AS section_2, "{b}" AS body_2, {n} AS place FROM se""" for n, (a, b) in enumerate(places, 1)),
        "greedy_token_scores": f"""WITH c4 AS (SELECT a.vec_id AS pair_id, {four} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings d ON d.vec_id = a.vec_id + 3),
            pr AS (SELECT pair_id, (greatest(ac, ad) + 2 * greatest(bc, bd)) / 3 AS p, (3 * greatest(ac, bc) + greatest(ad, bd)) / 4 AS r FROM c4)
            SELECT pair_id, {scaled('p')} AS precision, {scaled('r')} AS recall, {scaled('coalesce(2 * p * r / nullif(p + r, 0), 0.0)')} AS f1 FROM pr""",
    }


def build(k: int, replicates: int, seed: int) -> dict[str, str]:
    base = [
        """r0 AS (SELECT CAST(conv_id AS VARCHAR) AS essay_file, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS prompt,
            CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS INTEGER) AS response_index, text AS response
            FROM conversations WHERE role IN ('user', 'assistant'))""",
        "responses AS (SELECT * FROM r0)",
    ]
    balanced = [
        base[0],
        f"r1 AS (SELECT * FROM r0 WHERE response_index <= {k})",
        f"responses AS (SELECT * FROM r1 WHERE essay_file IN (SELECT essay_file FROM r1 GROUP BY 1 HAVING count(*) = {2 * k}))",
    ]

    def paired(*carry: str, of: str = "responses", name: str = "pairs") -> str:
        more = "".join(f", a.{c} AS {c}_1, b.{c} AS {c}_2" for c in carry)
        return f"""{name} AS (SELECT a.essay_file, a.prompt AS prompt_1, a.response_index AS response_index_1, b.prompt AS prompt_2,
            b.response_index AS response_index_2, a.prompt || b.prompt AS comparison_type{more} FROM {of} a JOIN {of} b ON a.essay_file = b.essay_file
            WHERE (a.prompt = b.prompt AND a.response_index <= b.response_index) OR (a.prompt = 'A' AND b.prompt = 'B'))"""

    def q(ctes: list[str], select: str) -> str:
        return "WITH " + ",\n".join(ctes) + "\n" + select

    p = [*base, paired("response")]
    pb = [*balanced, paired("response")]
    out = {
        "responses": q(base, "SELECT * FROM responses"),
        "canonical_pairs": q(p, f"SELECT {KEY}, comparison_type FROM pairs"),
        "resume_missing_pairs": q(pb, f"SELECT {KEY}, comparison_type FROM pairs WHERE comparison_type <> 'AA'"),
        "pair_coverage_violations": q(pb, f"SELECT {KEY}, 'missing' AS problem FROM pairs WHERE comparison_type <> 'AA'"),
        "sha256_digest": "SELECT conv_id, turn, sha256(text) AS digest FROM conversations",
        "derived_seed": q(
            base,
            """SELECT essay_file, prompt, response_index,
            ('0x' || substr(sha256('[42, "' || essay_file || '", "' || prompt || '", ' || response_index || ']'), 1, 8))::BIGINT AS seed FROM responses""",
        ),
    }
    out["response_violations"] = f"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS e, CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE role END AS p, turn AS i, text AS t FROM conversations),
        g AS (SELECT e, p, max(i) AS k, count(DISTINCT i) AS n FROM r GROUP BY ALL),
        s AS (SELECT e, count(DISTINCT p) AS ps, min(k) AS low, max(k) AS high, count(*) FILTER (WHERE k <> n) AS gaps FROM g GROUP BY e),
        v AS (SELECT 'blank_essay' AS rule, count(*) FILTER (WHERE e IS NULL OR trim(e) = '') AS rows FROM r
        UNION ALL SELECT 'unknown_prompt', count(*) FILTER (WHERE coalesce(p NOT IN ('A', 'B'), true)) FROM r
        UNION ALL SELECT 'blank_response', count(*) FILTER (WHERE t IS NULL OR trim(t) = '') FROM r
        UNION ALL SELECT 'bad_index', count(*) FILTER (WHERE coalesce(i < 1, true)) FROM r
        UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM r GROUP BY e, p, i HAVING count(*) > 1)
        UNION ALL SELECT 'incomplete_essay', count(*) FILTER (WHERE ps <> 2 OR gaps > 0 OR low <> {k} OR high <> {k}) FROM s)
        SELECT * FROM v WHERE rows > 0"""
    w = _words("text")
    out["mattr"] = f"WITH t AS (SELECT doc_id, coalesce({w}, []) AS w FROM documents) SELECT doc_id, len(w) AS tokens, floor(({_mattr('w')}) * 1000000 + 0.5) / 1000000 AS mattr FROM t"
    for n in (2, 3):
        out[f"ngram_counts_{n}"] = f"SELECT doc_id, phrase, count(*) AS cnt FROM (SELECT doc_id, unnest({_grams('text', n)}) AS phrase FROM documents) GROUP BY ALL"
    out["text_sizes"] = rf"""SELECT doc_id, len({_sentences('text')}) AS sentences, len({w}) AS words,
        len(regexp_extract_all(text, '{WORD}(?:[-''][\p{{L}}\p{{N}}_]+)*')) AS joined_words FROM documents"""
    lex = [
        *base,
        f"""lx AS (SELECT essay_file, prompt, response_index, {_mattr('w')} AS mattr, terms, grams2, grams3 FROM
            (SELECT *, {_words(_stripped('response'))} AS w, {_words(_stripped('response'), TERM)} AS terms, {_grams(_stripped('response'), 2)} AS grams2, {_grams(_stripped('response'), 3)} AS grams3 FROM responses))""",
        paired("mattr", "terms", "grams2", "grams3", of="lx", name="lp"),
        *_cosine_terms("terms", "tc"),
        *_divergence("grams2", "jsd2"),
        *_divergence("grams3", "jsd3"),
    ]
    out["tfidf_cosine_pairs"] = q(lex, f"SELECT {KEY}, round(tfidf, 6) AS tfidf FROM tc")
    out["phraseology_jsd"] = q(lex, f"SELECT {KEY}, round(jsd2, 6) AS jsd2, round(jsd3, 6) AS jsd3 FROM jsd2 LEFT JOIN jsd3 USING ({KEY})")
    parts = f"""parts AS (SELECT {KEY}, 1 - abs(mattr_1 - mattr_2) AS m, coalesce(tfidf, 0.0) AS t, (2 - coalesce(jsd2, 1.0) - coalesce(jsd3, 1.0)) / 2 AS ph
        FROM lp LEFT JOIN tc USING ({KEY}) LEFT JOIN jsd2 USING ({KEY}) LEFT JOIN jsd3 USING ({KEY}))"""
    out["lexical_similarity"] = q(
        [*lex, parts], f"SELECT {KEY}, round(m, 6) AS mattr_sim, round(t, 6) AS tfidf, round(ph, 6) AS phrase_sim, round(0.8 * (m + t) / 2 + 0.2 * ph, 6) AS lex FROM parts"
    )
    out["rescored_pairs"] = q([*lex, parts], f"SELECT {KEY}, round(0.8 * (m + t) / 2 + 0.2 * ph, 6) AS lex, CASE WHEN prompt_2 = 'A' THEN 'stored' ELSE 'scored' END AS source FROM parts")
    dot = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE))"
    out["embedding_meaning"] = f"""SELECT a.vec_id, round(greatest(0.0, least(1.0, ({dot('a.embedding', 'b.embedding')} / (sqrt({dot('a.embedding', 'a.embedding')}) * sqrt({dot('b.embedding', 'b.embedding')})) + 1) / 2)), 6) AS meaning
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
    matrix = [
        *base,
        f"rs AS (SELECT essay_file, prompt, response_index, {_sentences('response')} AS s FROM responses)",
        paired("s", of="rs", name="sp"),
        f"""sx AS (SELECT {KEY}, 1 AS side, unnest(range(len(s_1))) AS pos, unnest(s_1) AS s FROM sp UNION ALL SELECT {KEY}, 2, unnest(range(len(s_2))), unnest(s_2) FROM sp)""",
        f"nd AS (SELECT {KEY}, count(*) AS docs FROM sx GROUP BY ALL)",
        f"tm AS (SELECT {KEY}, side, pos, unnest({_words('s', TERM)}) AS term FROM sx)",
        f"tf AS (SELECT {KEY}, side, pos, term, count(*) AS tf FROM tm GROUP BY ALL)",
        f"df AS (SELECT {KEY}, term, count(*) AS df FROM tf GROUP BY ALL)",
        f"wt AS (SELECT {KEY}, side, pos, term, tf * (ln((1 + docs) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING ({KEY}, term) JOIN nd USING ({KEY}))",
        f"un AS (SELECT {KEY}, side, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY {KEY}, side, pos)) AS w FROM wt)",
        f"""cl AS (SELECT {KEY}, a.pos AS i, b.pos AS j, sum(a.w * b.w) AS score FROM (SELECT * FROM un WHERE side = 1) a JOIN (SELECT * FROM un WHERE side = 2) b USING ({KEY}, term) GROUP BY ALL)""",
        None,
    ]
    # the grid of cells, joined to the scores by position
    matrix[-1] = f"""cells AS (SELECT g.*, coalesce(cl.score, 0.0) AS score FROM (SELECT {', '.join('x.' + c for c in KEYS)}, CAST(x.pos AS INTEGER) AS i, CAST(y.pos AS INTEGER) AS j
            FROM sx x JOIN sx y ON {' AND '.join(f'x.{c} = y.{c}' for c in KEYS)} AND x.side = 1 AND y.side = 2) g LEFT JOIN cl ON {' AND '.join(f'g.{c} = cl.{c}' for c in [*KEYS, 'i', 'j'])})"""
    out["sentence_matrix_tfidf"] = q(matrix, f"SELECT {KEY}, i, j, round(score, 6) AS score FROM cells")
    slid = f"rs AS (SELECT essay_file, prompt, response_index, list_transform(range(1, len(s) + 1), lambda i: array_to_string(list_transform(range(0, 3), lambda o: s[least(i + o, len(s))]), ' ')) AS s FROM (SELECT *, {_sentences('response')} AS s FROM responses))"
    out["sliding_matrix"] = q([slid if c.startswith("rs AS") else c for c in matrix], f"SELECT {KEY}, i, j, round(score, 6) AS score FROM cells")

    def one_way(row: str, col: str) -> list[str]:
        n = f"sw_{row}"
        return [
            f"""{n}0 AS (SELECT {KEY}, {row}, {col}, count(*) OVER l AS n, max({row}) OVER (PARTITION BY {KEY}) + 1 AS m, exp((score - max(score) OVER l) / 0.1) AS e FROM cells WINDOW l AS (PARTITION BY {KEY}, {row}))""",
            f"{n}1 AS (SELECT *, e / sum(e) OVER (PARTITION BY {KEY}, {row}) AS w FROM {n}0)",
            f"""{n}2 AS (SELECT {KEY}, {row}, any_value(n) AS n, any_value(CASE WHEN m > 1 THEN {row} / (m - 1)::DOUBLE ELSE 0.0 END) AS x,
                sum(w * CASE WHEN n > 1 THEN {col} / (n - 1)::DOUBLE ELSE 0.0 END) AS y, sum(-greatest(1e-12, least(1.0, w)) * ln(greatest(1e-12, least(1.0, w)))) AS h FROM {n}1 GROUP BY {KEY}, {row})""",
            f"{n}3 AS (SELECT {KEY}, greatest(0.0, least(1.0, 1 - abs(x - y))) AS p, CASE WHEN n > 1 THEN greatest(0.0, least(1.0, 1 - h / ln(n))) ELSE 1.0 END AS c FROM {n}2)",
            f"{n} AS (SELECT {KEY}, CASE WHEN sum(c) = 0 THEN avg(p) ELSE sum(p * c) / sum(c) END AS side FROM {n}3 GROUP BY {KEY})",
        ]

    org = [*matrix, *one_way("i", "j"), *one_way("j", "i"), f"og AS (SELECT {KEY}, greatest(0.0, least(1.0, (a.side + b.side) / 2)) AS org FROM sw_i a JOIN sw_j b USING ({KEY}))"]
    out["soft_organization"] = q(org, f"SELECT {KEY}, round(org, 6) AS org FROM og")
    best = [
        *matrix,
        f"mt AS (SELECT {KEY}, i, j FROM (SELECT {KEY}, i, j, row_number() OVER (PARTITION BY {KEY}, i ORDER BY round(score, 6) DESC, j) AS rk FROM cells WHERE round(score, 6) > 0) WHERE rk = 1)",
        f"sz AS (SELECT {KEY}, len(s_1) AS n_a, len(s_2) AS n_b FROM sp)",
    ]
    out["kendall_tau_b"] = q(
        [
            *best,
            f"pr AS (SELECT {KEY}, sign(b.i - a.i) * sign(b.j - a.j) AS s, (a.i <> b.i)::INT AS x, (a.j <> b.j)::INT AS y FROM mt a JOIN mt b USING ({KEY}) WHERE (a.i, a.j) < (b.i, b.j))",
            f"ks AS (SELECT {KEY}, sum(s) AS s, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM pr GROUP BY {KEY})",
        ],
        f"SELECT {KEY}, round(CASE WHEN s IS NULL THEN 1.0 WHEN x * y = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (s / (sqrt(x) * sqrt(y)) + 1) / 2)) END, 6) AS tau FROM (SELECT DISTINCT {KEY} FROM mt) LEFT JOIN ks USING ({KEY})",
    )
    place = lambda c, n: f"CASE WHEN {n} > 1 THEN {c} / ({n} - 1)::DOUBLE ELSE 0.0 END"
    out["position_matching"] = q(best, f"SELECT {KEY}, round(avg(1 - abs({place('i', 'n_a')} - {place('j', 'n_b')})), 6) AS position FROM mt JOIN sz USING ({KEY}) GROUP BY {KEY}")

    def neighbours(a: str, b: str) -> list[str]:
        """Of the neighbouring units that both have a match: how many, and how many have neighbouring matches."""
        return [
            f"nb_{a} AS (SELECT {KEY}, x.{a} AS unit, max((y.{b} = x.{b} + 1)::INT) AS kept FROM mt x JOIN mt y USING ({KEY}) WHERE y.{a} = x.{a} + 1 GROUP BY {KEY}, x.{a})",
            f"nc_{a} AS (SELECT {KEY}, sum(kept) / count(*)::DOUBLE AS share FROM nb_{a} GROUP BY {KEY})",
        ]

    half = lambda n, c: f"CASE WHEN {n} < 2 THEN 1.0 ELSE coalesce({c}.share, 0.0) END"
    out["continuity"] = q(
        [*best, *neighbours("i", "j"), *neighbours("j", "i"), f"an AS (SELECT DISTINCT {KEY}, true AS matched FROM mt)"],
        f"""SELECT {KEY}, round(CASE WHEN matched THEN ({half('n_a', 'nc_i')} + {half('n_b', 'nc_j')}) / 2 ELSE 0.0 END, 6) AS sequence
        FROM sz LEFT JOIN an USING ({KEY}) LEFT JOIN nc_i USING ({KEY}) LEFT JOIN nc_j USING ({KEY})""",
    )
    out["multiset_jaccard"] = q(
        [
            *p,
            f"ws AS (SELECT {KEY}, unnest({_words('response_1')}) AS word, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT {KEY}, unnest({_words('response_2')}), 0, 1 FROM pairs)",
            f"wc AS (SELECT {KEY}, word, sum(a) AS a, sum(b) AS b FROM ws GROUP BY ALL)",
        ],
        f"SELECT {KEY}, round(sum(least(a, b)) / sum(greatest(a, b))::DOUBLE, 6) AS jaccard FROM wc GROUP BY {KEY}",
    )
    structure = _structure(base, paired, q)
    parse = structure.pop("ctes")
    out["conllu_tokens"] = q(
        parse,
        """SELECT rid, CAST(sentence_id AS INTEGER) AS sentence_id, CAST(token_id AS INTEGER) AS token_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY sentence_id, token_id) AS INTEGER) AS global_token_id,
        text, upos, CAST(coalesce(head, 0) AS INTEGER) AS head_token_id, rel AS dependency_relation FROM tk JOIN (SELECT rid, sentence_id, t + 1 AS token_id, text FROM wd) USING (rid, sentence_id, token_id)""",
    ).replace("WITH r0", "WITH RECURSIVE r0", 1)
    out["missing_responses"] = q(
        base,
        "SELECT * FROM (SELECT essay_file, prompt, CAST(i AS INTEGER) AS response_index FROM (SELECT DISTINCT essay_file FROM responses), (VALUES ('A'), ('B')) p(prompt), range(1, 6) r(i)) ANTI JOIN responses USING (essay_file, prompt, response_index)",
    )
    picked = "('0x' || substr(md5(response), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)"
    cos = f"{dot('embedding_1', 'embedding_2')} / (sqrt({dot('embedding_1', 'embedding_1')}) * sqrt({dot('embedding_2', 'embedding_2')}))"
    meaning = [
        paired("response", name="mp"),
        f"c0 AS (SELECT essay_file, prompt, response_index, {_words('response')} AS w FROM responses)",
        f"""c1 AS (SELECT *, list_transform(w, lambda x: list_transform(range(0, {WIDTH}), lambda d: ('0x' || substr(md5(x), 4 * d + 1, 4))::INT / 32768.0::DOUBLE - 1)) AS o FROM c0)""",
        f"""c2 AS (SELECT essay_file, prompt, response_index, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS token,
            unnest(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, {WIDTH + 1}), lambda d: o[i][d] + {NEIGHBOUR} * (coalesce(o[i - 1][d], 0) + coalesce(o[i + 1][d], 0))))) AS v FROM c1)""",
        "c3 AS (SELECT token, count(DISTINCT (essay_file, prompt, response_index)) AS df FROM c2 GROUP BY token)",
        """c4 AS MATERIALIZED (SELECT essay_file, prompt, response_index, p, ln(((SELECT count(*) FROM responses) + 1)::DOUBLE / (df + 1)) AS idf,
            list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM c2 JOIN c3 USING (token))""",
        f"""c5 AS MATERIALIZED (SELECT {', '.join('mp.' + x for x in KEYS)}, a.p AS i, b.p AS j, a.idf AS wi, b.idf AS wj, list_dot_product(a.v, b.v) AS cos FROM mp
            JOIN c4 a ON a.essay_file = mp.essay_file AND a.prompt = prompt_1 AND a.response_index = response_index_1 JOIN c4 b ON b.essay_file = mp.essay_file AND b.prompt = prompt_2 AND b.response_index = response_index_2)""",
        f"c6 AS (SELECT {KEY}, sum(best * w) / nullif(sum(w), 0) AS p FROM (SELECT {KEY}, i, any_value(wi) AS w, max(cos) AS best FROM c5 GROUP BY {KEY}, i) GROUP BY {KEY})",
        f"c7 AS (SELECT {KEY}, sum(best * w) / nullif(sum(w), 0) AS r FROM (SELECT {KEY}, j, any_value(wj) AS w, max(cos) AS best FROM c5 GROUP BY {KEY}, j) GROUP BY {KEY})",
        f"mr AS (SELECT {', '.join('mp.' + x for x in KEYS)}, coalesce(p, 0.0) AS p, coalesce(r, 0.0) AS r FROM mp LEFT JOIN c6 USING ({KEY}) LEFT JOIN c7 USING ({KEY}))",
        f"me AS (SELECT essay_file, prompt, response_index, embedding FROM (SELECT *, {picked} AS vec_id FROM responses) JOIN embeddings USING (vec_id))",
        paired("embedding", of="me", name="ep"),
        f"mn AS (SELECT {KEY}, (coalesce(2 * p * r / nullif(p + r, 0), 0.0) + coalesce(greatest(0.0, least(1.0, ({cos} + 1) / 2)), 0.0)) / 2 AS meaning FROM mp LEFT JOIN mr USING ({KEY}) LEFT JOIN ep USING ({KEY}))",
    ]
    contextual = [*base, *meaning[:-3]]
    out["contextual_similarity"] = q(contextual, f"SELECT {KEY}, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM mr")
    out["meaning"] = q([*base, *meaning], f"SELECT {KEY}, round(meaning, 6) AS meaning FROM mn")
    v = [
        *org, *lex[len(base):], parts, *parse[len(base):], *meaning, paired(),
        "rc AS (SELECT essay_file, max(response_index) AS response_count FROM responses GROUP BY 1)",
        f"""vectors AS MATERIALIZED (SELECT {KEY}, comparison_type, response_count, round(coalesce(org, 0.0), 12) AS org, round(0.8 * (pt.m + pt.t) / 2 + 0.2 * pt.ph, 12) AS lex, round(meaning, 12) AS meaning,
            round((sm.n + sm.t) / 2, 12) AS struct FROM pairs JOIN rc USING (essay_file) LEFT JOIN og USING ({KEY}) JOIN parts pt USING ({KEY}) JOIN mn USING ({KEY}) JOIN sm USING ({KEY}))""",
    ]
    rounds = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
    out["vectors"] = q(v, f"SELECT {KEY}, comparison_type, response_count, {rounds(COMPONENTS)} FROM vectors")
    out["vector_violations"] = q(
        v,
        f"""SELECT 'wrong_type' AS rule, count(*) AS rows FROM vectors WHERE response_index_2 = {k} HAVING count(*) > 0""",
    )
    centred = " + ".join(f"({c} - avg({c}) OVER g) ** 2" for c in COMPONENTS)
    d = [
        *v,
        f"""dist AS (SELECT essay_file, prompt_1 AS prompt, response_index_1, response_index_2, {', '.join(COMPONENTS)}, sqrt({centred}) AS distance FROM vectors
            WHERE comparison_type IN ('AA', 'BB') AND response_index_1 <> response_index_2 WINDOW g AS (PARTITION BY essay_file, prompt_1))""",
    ]
    out["vector_distances"] = q(d, f"SELECT essay_file, prompt, response_index_1, response_index_2, {rounds([*COMPONENTS, 'distance'])} FROM dist")
    means, sds = [f"{c}_mean" for c in COMPONENTS], [f"{c}_sd" for c in COMPONENTS]
    within = [
        *d,
        f"""wi AS (SELECT essay_file, prompt, count(*) AS pair_count, avg(distance) AS mean_distance, {', '.join(f'avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd' for c in COMPONENTS)}
            FROM dist GROUP BY ALL)""",
    ]
    out["within_stability"] = q(within, f"SELECT essay_file, prompt, pair_count, {rounds(['mean_distance', *means, *sds])} FROM wi")
    metrics = ["mean_distance", *means]
    out["between_stability"] = q(
        [*within, "ml AS (" + " UNION ALL ".join(f"SELECT prompt, '{m}' AS metric, {m} AS x FROM wi" for m in metrics) + ")",
         """sb AS (SELECT prompt, metric, count(x) AS "count", avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS "min", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS "max" FROM ml GROUP BY ALL)"""],
        """SELECT prompt, metric, "count", round(mean, 6) AS mean, round(sd, 6) AS sd, round("min", 6) AS "min", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round("max", 6) AS "max",
        round(q3 - q1, 6) AS iqr, round("max" - "min", 6) AS "range", round(sd / mean, 6) AS cv FROM sb""",
    )
    sides = [f"{t}_{c}" for t in ("aa", "bb", "ab") for c in COMPONENTS]
    shift = [
        *v,
        f"""cs AS (SELECT essay_file, {', '.join(f"avg({c}) FILTER (WHERE comparison_type = '{t.upper()}') AS {t}_{c}" for t in ('aa', 'bb', 'ab') for c in COMPONENTS)} FROM vectors
            WHERE comparison_type = 'AB' OR response_index_1 <> response_index_2 GROUP BY essay_file)""",
        f"ba AS (SELECT *, {', '.join(f'(aa_{c} + bb_{c}) / 2 AS baseline_{c}' for c in COMPONENTS)} FROM cs)",
        f"de AS (SELECT *, {', '.join(f'ab_{c} - baseline_{c} AS delta_{c}' for c in COMPONENTS)} FROM ba)",
        f"sh AS (SELECT *, sqrt({' + '.join(f'delta_{c} ** 2' for c in COMPONENTS)}) AS magnitude FROM de)",
    ]
    deltas = [f"delta_{c}" for c in COMPONENTS]
    out["prompt_shift"] = q(shift, f"SELECT essay_file, {rounds([*sides, *[f'baseline_{c}' for c in COMPONENTS], *deltas, 'magnitude'])} FROM sh")
    out["overall_prompt_shift"] = q(shift, f"SELECT count(magnitude) AS essay_count, {', '.join(f'round(avg({x}), 6) AS {x}' for x in ['magnitude', *deltas])} FROM sh")
    out["hotelling_t2"] = _hotelling(shift, q)
    # counters mixed in unsigned integers: a stream for each replicate, then a number for each slot of an attempt
    turned = lambda xs, shift, factor: f"list_transform({xs}, lambda x: xor(x, x >> {shift}) * {factor} % 4294967296)"
    mix = lambda xs: f"list_transform({turned(turned(xs, 16, MIX[0]), 15, MIX[1])}, lambda x: xor(x, x >> 16))"
    key = f"('0x' || substr(md5(concat_ws('|', '{seed}', essay_file, prompt)), 1, 8))::UBIGINT"
    stream = mix(f"[({key} + replicate::UBIGINT * {REPLICATE_STEP}) % 4294967296]") + "[1]"
    counters = lambda attempt: f"list_transform(range({attempt} * k, {attempt + 1} * k), lambda c: (stream + c::UBIGINT * {SLOT_STEP}) % 4294967296)"
    draw = lambda attempt: f"list_transform({mix(counters(attempt))}, lambda x: (x % k::UBIGINT)::BIGINT + 1)"
    again = "len(list_distinct(ids)) < 2"
    last = 40
    boot = [
        *d,
        "kp AS (SELECT essay_file, prompt_1 AS prompt, max(response_index_2) AS k FROM vectors WHERE comparison_type <> 'AB' GROUP BY ALL HAVING max(response_index_2) > 1)",
        f"t0 AS MATERIALIZED (SELECT *, {draw(0)} AS ids FROM (SELECT essay_file, prompt, k, replicate, {stream} AS stream FROM kp, range(1, {replicates + 1}) r(replicate)))",
        *[f"t{n} AS MATERIALIZED (SELECT essay_file, prompt, k, replicate, stream, {draw(n)} AS ids FROM t{n - 1} WHERE {again})" for n in range(1, last)],
        "dr AS (" + " UNION ALL ".join(f"SELECT essay_file, prompt, replicate, unnest(ids) AS id FROM t{n} WHERE NOT ({again})" for n in range(last)) + ")",
        "ct AS MATERIALIZED (SELECT essay_file, prompt, replicate, id, count(*) AS m FROM dr GROUP BY ALL)",
        f"""bw0 AS (SELECT essay_file, prompt, replicate, a.m * b.m AS w, {', '.join(COMPONENTS)} FROM dist JOIN ct a USING (essay_file, prompt) JOIN ct b USING (essay_file, prompt, replicate)
            WHERE a.id = response_index_1 AND b.id = response_index_2)""",
        f"bw1 AS (SELECT *, sqrt({' + '.join(f'({c} - sum(w * {c}) OVER g / sum(w) OVER g) ** 2' for c in COMPONENTS)}) AS distance FROM bw0 WINDOW g AS (PARTITION BY essay_file, prompt, replicate))",
        f"bw AS (SELECT essay_file, prompt, replicate, sum(w * distance) / sum(w) AS mean_distance, {', '.join(f'sum(w * {c}) / sum(w) AS {c}_mean' for c in COMPONENTS)} FROM bw1 GROUP BY essay_file, prompt, replicate)",
        f"""bx AS (SELECT essay_file, replicate, {', '.join(f'sum(a.m * b.m * {c}) / sum(a.m * b.m) AS {c}' for c in COMPONENTS)} FROM vectors JOIN (SELECT * FROM ct WHERE prompt = 'A') a USING (essay_file)
            JOIN (SELECT * FROM ct WHERE prompt = 'B') b USING (essay_file, replicate) WHERE comparison_type = 'AB' AND response_index_1 = a.id AND response_index_2 = b.id GROUP BY ALL)""",
        f"""bd AS (SELECT essay_file, replicate, {', '.join(f'bx.{c} - (x.{c}_mean + y.{c}_mean) / 2 AS delta_{c}' for c in COMPONENTS)} FROM bx JOIN (SELECT * FROM bw WHERE prompt = 'A') x USING (essay_file, replicate)
            JOIN (SELECT * FROM bw WHERE prompt = 'B') y USING (essay_file, replicate))""",
        f"bs AS (SELECT *, sqrt({' + '.join(f'delta_{c} ** 2' for c in COMPONENTS)}) AS magnitude FROM bd)",
    ]
    out["bootstrap_within"] = q(boot, f"SELECT essay_file, prompt, replicate, {rounds(metrics)} FROM bw")
    out["bootstrap_shift"] = q(boot, f"SELECT essay_file, replicate, {rounds(['magnitude', *deltas])} FROM bs")
    out["bootstrap_overall"] = q(boot, f"SELECT replicate, {', '.join(f'round(avg({x}), 6) AS {x}' for x in ['magnitude', *deltas])} FROM bs GROUP BY replicate")

    def interval(groups: str, names: list[str], of: str, directional: list[str]) -> str:
        return " UNION ALL ".join(
            f"""SELECT {groups}, '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.975), 6) AS high,
            {f'round(avg(({m} >= 0)::INT), 6)' if m in directional else 'NULL::DOUBLE'} AS directional FROM {of} GROUP BY {groups}"""
            for m in names
        )

    out["within_intervals"] = q(boot, interval("essay_file, prompt", metrics, "bw", []))
    out["shift_intervals"] = q(boot, interval("essay_file", ["magnitude", *deltas], "bs", deltas))
    out["chart_intervals"] = q(
        [*boot, *within[len(d):]],
        """SELECT essay_file, prompt, round(any_value(wi.mean_distance), 6) AS mean_distance, round(quantile_cont(bw.mean_distance, 0.025), 6) AS low, round(quantile_cont(bw.mean_distance, 0.975), 6) AS high
        FROM bw JOIN wi USING (essay_file, prompt) GROUP BY essay_file, prompt""",
    )
    stem = r"regexp_replace(regexp_extract(essay_file, '[^/]*$'), '(.)\.[^.]+$', '\1')"
    panels = " UNION ALL ".join(f"SELECT essay_file, prompt, '{c}' AS component, round({c}_mean, 6) AS similarity FROM wi" for c in COMPONENTS)
    out["chart_components"] = q(
        [*within, f"panels AS ({panels})", f"stems AS (SELECT *, {stem} AS stem FROM panels)", "parted AS (SELECT *, string_split(stem, '_') AS parts FROM stems)"],
        "SELECT essay_file, CASE WHEN len(parts) > 2 THEN array_to_string(parts[3:], '_') ELSE stem END AS name, prompt, component, similarity FROM parted",
    )
    out |= structure
    for name, sql in out.items():
        if "vectors AS MATERIALIZED" in sql:
            out[name] = sql.replace("WITH r0", "WITH RECURSIVE r0", 1)
    out["stratified_sample"] = """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 0, doc_id)), doc_id) AS n FROM documents) WHERE n <= 10"""
    return out | _texts()
