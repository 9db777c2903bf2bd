"""One query per training-data operator, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.llm import (
    chat, decontaminate, fingerprints, jaccard, language, licenses, lines, mixing, packing, phrases, search, tokens, warc,
)
from logprism.llm.common import prepare, store, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_read_back(table(prepare(spark), sf_dir, "pages"))


SQL_1 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
    SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.document_files(table(prepare(spark), sf_dir, "documents"))
    return licenses.license_scan(files).withColumnRenamed("file", "doc_id")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_2 = f"""
WITH t(template, license, text) AS (
    VALUES {", ".join(f"({k}, {_quote(name)}, {_quote(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))}
), tc AS (
    SELECT template, license, word, count(*) AS tf FROM (
        SELECT template, license, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM t)
    WHERE word <> '' GROUP BY ALL
), idf AS (
    SELECT word, ln({len(licenses.TEMPLATES)} + 1.0) - ln(count(*) + 0.5) + 0.1 AS idf FROM tc GROUP BY word
), tr AS (SELECT tc.*, tf * idf AS raw FROM tc JOIN idf USING (word)
), tv AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY template)) AS weight FROM tr
), f AS (
    SELECT doc_id, text, doc_id % 10 = 0 AS lic, (doc_id // 1000)::VARCHAR AS top,
        CASE WHEN doc_id % 1000 = 0 THEN (doc_id // 1000)::VARCHAR
             ELSE (doc_id // 1000)::VARCHAR || '/' || (doc_id // 10)::VARCHAR END AS home
    FROM documents
), st AS (
    SELECT doc_id, 'lines' AS part, array_to_string(list_filter(string_split(text, chr(10)),
        lambda l: regexp_matches(l, {_quote(licenses.CUE)})), chr(10)) AS s FROM f
    UNION ALL SELECT doc_id, 'whole', text FROM f WHERE lic
), w AS (
    SELECT doc_id, part, word, count(*) AS tf FROM (
        SELECT doc_id, part, unnest(string_split_regex(lower(s), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM st)
    WHERE word <> '' GROUP BY ALL
), ww AS (
    SELECT w.*, tf * coalesce(idf, (SELECT max(idf) FROM idf)) AS raw FROM w LEFT JOIN idf USING (word)
), nn AS (SELECT doc_id, part, sqrt(sum(raw * raw)) AS norm FROM ww GROUP BY ALL
), c AS (
    SELECT doc_id, license, round(least(sum(ww.raw * weight) / any_value(norm), 1.0), 9) AS cosine
    FROM ww JOIN tv USING (word) JOIN nn USING (doc_id, part) GROUP BY doc_id, part, template, license
), own AS (
    SELECT doc_id, license, cosine FROM c WHERE cosine >= {licenses.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1
), g AS (SELECT home, license FROM own JOIN f USING (doc_id) WHERE lic
)
SELECT f.doc_id, f.home || CASE WHEN f.lic THEN '/LICENSE' ELSE '/' || f.doc_id || '.txt' END AS path,
       coalesce(own.license, near.license, far.license) AS license, own.cosine,
       CASE WHEN own.license IS NOT NULL THEN 'own'
            WHEN coalesce(near.license, far.license) IS NOT NULL THEN 'inherited' END AS origin
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN g near ON near.home = f.home LEFT JOIN g far ON far.home = f.top
"""


#: A conversation whose texts are full of the template's own control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(planted))).drop("bad_turn")


def _marks_sql() -> str:
    """Code points that marks and escapes add to a turn, as SQL."""
    marks = " ".join(
        f"WHEN '{role}' THEN {len(open_) + len(close)}" for role, (open_, close, _) in chat.TEMPLATE.items())
    escapes = " + ".join(
        f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in ["\\", *chat.control_strings()])
    other = len(chat.OTHER[0]) + len(chat.OTHER[1]) + 1
    return f"(CASE role {marks} ELSE {other} + length(role) END + {escapes})"


SQL_3 = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{HOSTILE}'
    UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(text) + {_marks_sql()}) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role || ',', '' ORDER BY turn, role, text), '(system,)?(user,assistant,)+') AS valid
FROM t GROUP BY conv_id
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return mixing.documents_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _number(*parts: str) -> str:
    """``common.key_hash`` as SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


_B, _SHARD = mixing.BLOCK_WORDS, mixing.SHARD_WORDS
SQL_4 = f"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
        ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
    FROM d GROUP BY source
), f AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s
), t AS (
    SELECT source, source_size, coalesce(least(cap, w * (
        SELECT level FROM f WHERE level * w < cap ORDER BY cap / w, source NULLS LAST LIMIT 1)), cap) AS target FROM f
), q AS (
    SELECT source, unnest(range(0, CAST(round(target / {_B}) AS BIGINT) + 5)) AS k FROM t
), b AS (
    SELECT source, count(*) AS blocks FROM (
        SELECT q.source, row_number() OVER (ORDER BY t.target / (2 * k + 1) DESC, t.source IS NULL, t.source, k) AS r
        FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source WHERE t.target > 0)
    WHERE r <= (SELECT round(sum(target) / {_B}) FROM t) GROUP BY source
), p AS (
    SELECT d.*, t.source_size, t.target, coalesce(b.blocks, 0) AS blocks, {_number("'mix-shard'", "d.doc_id::VARCHAR")}
        % greatest(1, CAST(ceil(t.source_size / {_SHARD}.0) AS BIGINT)) AS shard, {_number("'mix-place'", "d.doc_id::VARCHAR")} AS place
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
), c AS (
    SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard) AS BIGINT) AS shard_size, CAST(sum(size) OVER (
        PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM p
), h AS (SELECT DISTINCT source, shard, shard_size, blocks FROM c
), hq AS (
    SELECT source, shard, count(*) AS quota FROM (
        SELECT source, shard, blocks, row_number() OVER (
            PARTITION BY source ORDER BY shard_size / (2.0 * k + 1) DESC, shard, k) AS r
        FROM (SELECT *, unnest(range(0, blocks)) AS k FROM h WHERE shard_size > 0))
    WHERE r <= blocks GROUP BY ALL
), m AS (
    SELECT c.*, e - size AS st, greatest(1, CAST(ceil(c.shard_size / {_B}.0) AS BIGINT)) AS n, coalesce(quota, 0) AS quota,
        {_number("'mix-blocks'", "coalesce(c.source, '')", "c.shard::VARCHAR")} AS draw
    FROM c LEFT JOIN hq ON c.source IS NOT DISTINCT FROM hq.source AND c.shard = hq.shard
), z AS (SELECT *, least(quota, 2 * n) AS qq, ({list(mixing.STEPS)})[1 + draw % 4] % n AS step, draw % n AS start FROM m)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(
    range(st // {_B}, (e - 1) // {_B} + 1), lambda x: (least(e, (x + 1) * {_B}) - greatest(st, x * {_B}))
        * (qq // n + CASE WHEN (x * step + start) % n < qq % n THEN 1 ELSE 0 END))) END AS BIGINT) AS taken
FROM z
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(prepare(spark), sf_dir, "documents"))


SQL_5 = """
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
    SELECT doc_id, doc_id AS c FROM documents
    UNION
    SELECT p.x, r.c FROM r JOIN p ON p.y = r.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY ALL
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.documents_language(table(prepare(spark), sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(prepare(spark), sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(prepare(spark), sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(prepare(spark), sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A text's words with A-Z in lower case, as search and phrases take it.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL_11 = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), s AS (
    SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0
), q AS (
    SELECT i, item_id, term, count(*) AS qtf FROM (
        SELECT i, item_id, unnest({_TERMS}) AS term FROM (
            SELECT *, row_number() OVER () AS i FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL
), t AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL
), v AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM t, s GROUP BY term, nd
), x AS (
    SELECT i, item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score
    FROM t JOIN v USING (term) JOIN q USING (term), s GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= {search.TOP}
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        pieces = packing.token_pieces(table(prepare(spark), sf_dir, "documents"), file.read())
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.placed(store(pieces, "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(prepare(spark), sf_dir, "documents"))


SQL_13 = f"""
WITH d AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), f AS (
    SELECT lang, g, CAST(count(*) AS HUGEINT) AS f FROM (
        SELECT lang, unnest(list_concat(
            list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS g FROM d)
    GROUP BY ALL
), n AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang
), c AS (
    SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND f >= {phrases.LEAST}
), s AS (
    SELECT c.*, h.f AS l, t.f AS r, (1000000 * a * a) // (h.f * t.f) AS score
    FROM c JOIN f h ON h.lang = c.lang AND h.g = c.g[1:c.k] JOIN f t ON t.lang = c.lang AND t.g = c.g[c.k + 1:]
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1
), m AS (
    SELECT lang, g, max(a) AS longer FROM (
        SELECT lang, g[1:2] AS g, a FROM s WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], a FROM s WHERE len(g) = 3)
    GROUP BY ALL
), k AS (
    SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM s LEFT JOIN m ON m.lang = s.lang AND m.g = s.g
    WHERE longer IS NULL OR 100 * longer < {phrases.INSIDE_PERCENT} * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
    CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM k JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {phrases.TOP}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_license_scan": op2_license_scan,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_mixing": op4_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_packing": op12_packing,
    "op13_phrases": op13_phrases,
}
SQL: dict[str, str] = {
    "op1_warc": SQL_1,
    "op2_license_scan": SQL_2,
    "op3_chat_formatting": SQL_3,
    "op4_mixing": SQL_4,
    "op5_jaccard_join": SQL_5,
    "op11_lexical_search": SQL_11,
    "op13_phrases": SQL_13,
}
