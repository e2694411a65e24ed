"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import chat, decontaminate, factorisation, fertility, fill_middle, jaccard_join
from tillcast.llm import language_model, licenses, merkle, mixing, near_dup, sentences, sharding
from tillcast.session import small_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, ["doc_id"], size=3, percent=85)


#: The words are those that the operator cuts; whole texts, all pairs that share a shingle.
OP1_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g'), ' '),
        lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
        THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1),
        lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y
    ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
    WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
    SELECT a, b FROM both_ways
    UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id))
    AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op2_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rated = fertility.rate(docs, ["doc_id"])
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rated.select(*first, *[c for c in rated.columns if c not in first])


def op5_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix(docs).select(
        "doc_id",
        "source",
        "lang",
        "mix.topic",
        "mix.tokens",
        F.round("mix.weight", 6).alias("weight"),
        F.round("mix.probability", 6).alias("probability"),
        "mix.kept",
    )


def op5_sql() -> str:
    """The same rounds, written out one after the other."""
    steps = ["w0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS raked FROM cells3)"]
    for i in range(3 * mixing.ROUNDS):
        m = mixing.MARGINS[i % 3]
        steps.append(
            f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (raked * to_{m} / sum(raked) OVER "
            f"(PARTITION BY {m}) AS raked) FROM w{i})"
        )
    targets = []
    for i, m in enumerate(mixing.MARGINS):
        power = f"pow(sum(tokens), {mixing.POWERS[m]}::DOUBLE)"
        targets.append(
            f"t{i} AS (SELECT {m}, {power} / sum({power}) OVER () * sum(sum(tokens)) OVER () AS to_{m} "
            f"FROM cells{i} GROUP BY {m}), cells{i + 1} AS MATERIALIZED (SELECT c.*, to_{m} "
            f"FROM cells{i} c JOIN t{i} USING ({m}))"
        )
    return f"""
WITH d AS (
    SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents
), e AS (
    SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^ \t-\r]+')) + 1 AS tokens,
        CASE WHEN length(text) - length(replace(text, '|', '')) >= 5 THEN 'table'
            WHEN length(text) < 600 THEN 'brief' WHEN length(text) >= 5000 THEN 'long'
            ELSE 'prose' END AS topic,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text)) || '|7'), 1, 13) AS BIGINT)
            / 4503599627370496.0::DOUBLE AS chance FROM d
), f AS (
    SELECT *, coalesce('=' || source, '') AS s, coalesce('=' || lang, '') AS l FROM e
), cells0 AS (
    SELECT s AS source, l AS lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY ALL
), {', '.join(targets)}, {', '.join(steps)},
r AS (SELECT source, lang, topic, tokens, raked, raked / tokens AS weight FROM w{3 * mixing.ROUNDS}),
o AS (
    SELECT *, {mixing.KEEP}::DOUBLE * sum(tokens) OVER () AS budget, sum(raked) OVER () AS total,
        coalesce(sum(tokens) OVER before, 0) AS whole, coalesce(sum(raked) OVER before, 0) AS gone
    FROM r WINDOW before AS (ORDER BY weight DESC, source, lang, topic
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
    SELECT max((budget - whole) / (total - gone)) AS scale FROM o
    WHERE total - gone > 1e-9 * total AND (budget - whole) / (total - gone) * weight <= 1
), p AS (SELECT r.*, least(1.0::DOUBLE, scale * weight) AS probability FROM r, c)
SELECT doc_id, f.source, f.lang, f.topic, CAST(f.tokens AS BIGINT) AS tokens,
    round(weight, 6) AS weight, round(probability, 6) AS probability, chance < probability AS kept
FROM f JOIN p ON p.source = s AND p.lang = l AND p.topic = f.topic
"""


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("overlaps.item_id")))
    return found.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        items.alias("item_ids"),
        F.size("overlaps").cast("long").alias("n_overlaps"),
        F.coalesce(F.array_max(F.col("overlaps.equal")), F.lit(0)).cast("long").alias("most_equal"),
    )


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shard(docs, shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = factorisation.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(factorisation.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return factorisation.score(docs, machine).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql_words(text: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), "
        "lambda x: x <> '')"
    )


def sql_shingles(words: str, n: int) -> str:
    return (
        f"CASE WHEN len({words}) < {n} THEN [] ELSE list_transform(range(1, len({words}) - {n - 2}), "
        f"lambda i: array_to_string({words}[i:i + {n - 1}], ' ')) END"
    )


def op8_sql() -> str:
    quoted = ", ".join(
        f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in licenses.TEMPLATES
    )
    n = licenses.SHINGLE
    return f"""
WITH templates(license, text) AS (VALUES {quoted}),
t AS (SELECT license, {sql_words('text')} AS w FROM templates),
own AS (SELECT DISTINCT license, unnest({sql_shingles('w', n)}) AS s FROM t),
total AS (SELECT license, count(*) AS n FROM own GROUP BY license),
d AS (SELECT DISTINCT doc_id, text, {sql_words('text')} AS w FROM documents WHERE text IS NOT NULL),
has AS (SELECT DISTINCT doc_id, text, unnest({sql_shingles('w', n)}) AS s FROM d),
shared AS (SELECT doc_id, text, license, count(*) AS k FROM has JOIN own USING (s) GROUP BY ALL)
SELECT doc_id, license, k AS n_shared, n AS n_shingles, round(k / n, 6) AS containment
FROM shared JOIN total USING (license) WHERE k >= {licenses.CONTAINED} * n
"""


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.remove_repeats(docs)


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op10_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = small_table(
        spark,
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def escaped(column: str) -> str:
    return f"regexp_replace({column}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"


OP10_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}'
    UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), o AS (
    SELECT *, row_number() OVER w AS n, lag(role) OVER w AS previous FROM t
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), ''))
        AS loss_sha256,
    CAST(sum(length({escaped('text')}) + CASE WHEN previous = role THEN length('{chat.NEXT}')
        ELSE length('{chat.START}{chat.SEP}{chat.END}') + 1 + length({escaped('role')}) END) AS BIGINT)
        AS formatted_chars
FROM o GROUP BY conv_id
"""


def op11_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.jaccard_join(docs, ["doc_id"], size=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


#: All pairs of whole texts that share a shingle; texts of equal sets count once.
OP11_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g'), ' '),
        lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5
        THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3),
        lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (
    SELECT doc_id, count(*) AS n, list_sort(list(s)) AS own FROM s GROUP BY doc_id
), c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY own) AS class_id FROM n),
one AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM one x JOIN one y
    ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b
    WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach(a, b) AS (
    SELECT a, b FROM links
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(least(class_id, low), d.doc_id) AS component_id,
    coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN low ON low.a = class_id
LEFT JOIN counts ON counts.a = class_id
"""


def op12_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    # Every second row is read back without its line ends.
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = merkle.leaf_hash(*[text if c == "text" else F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(docs.withColumn("seen", seen), ["doc_id", "seen"])
    folded = found.withColumn("folded_root", merkle.fold(F.col("seen"), F.col("path")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_hash(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_sql(leaf_levels: int = 13, source_levels: int = 6) -> str:
    """The same tree, level by level; enough levels for 3 ** 13 rows a source and 729 sources."""

    def leaf(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    bits = "list_transform(range(0, 8 * len(d)), lambda i: CASE WHEN i % 8 = 0 THEN ord(d[i // 8 + 1]) ELSE 0 END)"
    crc = (
        f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda c, v: xor(xor(c, v) >> 1, "
        "CASE WHEN xor(c, v) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    )
    steps = [
        "e AS MATERIALIZED (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents)",
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS source, {leaf('text')} AS leaf,
            CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS seen
            FROM e)""",
        """o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source) - 1 AS s,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)""",
        """p0 AS (SELECT doc_id, leaf, s, i, seen AS folded, '' AS proof FROM o)""",
        "n0 AS (SELECT s, i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM o)",
    ]

    def level(k: int, key: str, place: str) -> list[str]:
        """From the nodes n{k} of each key, and the documents p{k} below them, one level up."""
        run = f"PARTITION BY {key}, {place} // 3 ORDER BY {place} ROWS BETWEEN"
        return [
            f"""a{k} AS MATERIALIZED (SELECT *,
                coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM n{k})""",
            f"""p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (
                CASE WHEN n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded,
                CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof, p.{place} // 3 AS {place})
                FROM p{k} p JOIN a{k} a ON a.{key} = p.{key} AND a.{place} = p.{place})""",
            f"""n{k + 1} AS MATERIALIZED (SELECT {key}, {place} // 3 AS {place},
                CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY {place})) END AS h,
                CASE WHEN n = 1 THEN 1 ELSE (n + 2) // 3 END AS n FROM a{k} GROUP BY {key}, {place} // 3, n)""",
        ]

    for k in range(leaf_levels):
        steps += level(k, "s", "i")
    k = leaf_levels
    steps += [
        f"""p{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, folded, proof, h AS subroot, 0 AS g, s AS j
            FROM p{k} JOIN n{k} USING (s))""",
        f"n{k + 1} AS MATERIALIZED (SELECT 0 AS g, s AS j, h, count(*) OVER () AS n FROM n{k})",
    ]
    for k in range(leaf_levels + 1, leaf_levels + 1 + source_levels):
        steps += level(k, "g", "j")
    k = leaf_levels + 1 + source_levels
    return f"""WITH {', '.join(steps)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
    folded = h AS verified FROM p{k}, n{k}"""


def op13_wavelet_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fill_middle.transform(docs, ["doc_id"])
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_sql() -> str:
    drawn = ", ".join(
        f"CAST('0x' || substr(sha256('42:' || doc_id), {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4)
    )
    p, s, m = (f"'{x}'" for x in (fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE))
    return f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, {drawn},
        regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS units FROM documents
), c AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m})
            OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), t AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
        array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
        ELSE {s} || suffix || {p} || prefix || {m} || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM t
"""


QUERIES = {
    "op1_lsh_forest": op1_lsh_forest,
    "op2_gated_recurrent": op2_gated_recurrent,
    "op3_sampled_splitters": op3_sampled_splitters,
    "op4_fertility": op4_fertility,
    "op5_raking": op5_raking,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_factorisation_machine": op7_factorisation_machine,
    "op8_license_windows": op8_license_windows,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_relational_chat": op10_relational_chat,
    "op11_set_relations": op11_set_relations,
    "op12_butterfly_manifest": op12_butterfly_manifest,
    "op13_wavelet_cuts": op13_wavelet_cuts,
}
SQL = {
    "op1_lsh_forest": OP1_SQL,
    "op5_raking": op5_sql(),
    "op8_license_windows": op8_sql(),
    "op10_relational_chat": OP10_SQL,
    "op11_set_relations": OP11_SQL,
    "op12_butterfly_manifest": op12_sql(),
    "op13_wavelet_cuts": op13_sql(),
}
