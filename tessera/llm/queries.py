"""The registered queries of this subpackage: thin digests over the operators, and their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_remainder
from tessera.storage import load


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_own_key = secrets.token_hex(16)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's ``spark.tessera.pii.key``; where it isn't set, a random key of this process."""
    return spark.conf.get("spark.tessera.pii.key", _own_key)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = load(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 0
    machine = toxicity.fit(docs, load(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii

    out = pii.pseudonymise(load(spark, sf_dir, "documents"), pseudonym_key(spark))
    kinds = F.transform("__finds", lambda f: f["kind"])
    return out.select("doc_id", "text", F.size("__finds").cast("long").alias("n_finds"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import packing

    pieces = packing.pack(load(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import ngram_join

    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontam

    index = decontam.build_index(load(spark, sf_dir, "benchmark"))
    return decontam.find_contamination(load(spark, sf_dir, "documents"), index)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    docs = load(spark, sf_dir, "documents")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    out = quality.classify(docs, model)
    score = F.col("__quality")
    return out.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("keep"))


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose two turns consist of the template's own control strings."""
    text = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import chat

    out = chat.format_chat(with_control_case(load(spark, sf_dir, "conversations")))
    out = out.withColumn("parsed", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    joined = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import langid

    docs = load(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    parser = langid.fit(docs, ~held_out)
    return langid.predict(docs, parser).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import media

    images = media.text_to_media(load(spark, sf_dir, "documents"))
    return media.media_features(images).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import tokens

    return tokens.count_tokens(load(spark, sf_dir, "documents"), vocabulary())


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode(load(spark, sf_dir, "documents"), path).withColumn("decoded", pieces.decode(F.col("ids"), path))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import spelling

    # only runs of 7 letters or more can give a word
    runs = spelling.runs_of_letters(load(spark, sf_dir, "documents").select("doc_id", "text"), "[A-Za-z\u00C0-\u00FF]{7,}")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.withColumn("h", h)
    word = F.when(F.col("h") % 31 == 0, spelling.without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= 7).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spelling.group_variants(words.where("n >= 2"), ratio=10, least_length=7)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import merkle

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    odd = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    tampered = merkle.leaf(*[F.col(c) for c in fields[:-1]], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf(*map(F.col, fields)).alias("leaf"), F.when(odd, tampered).alias("tampered"))
    out = merkle.manifest(docs, "source", ["doc_id"], "leaf")
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.digest_of_proof(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_MARKS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>"]


def _escaped_length(x: str) -> str:
    """Length of the escaped form: one more for each backslash, and 2 in place of each marker."""
    lost = " - ".join(f"({len(m) - 2}) * ((length({x}) - length(replace({x}, '{m}', ''))) / {len(m)})" for m in _MARKS)
    return f"(length({x}) + (length({x}) - length(replace({x}, '\\', ''))) - {lost})"


OP7_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), states AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped_length("text")} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE {sum(map(len, _MARKS[6:]))} + {_escaped_length("role")} END) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(CASE
    WHEN before IS NULL THEN role IN ('system', 'user') ELSE (before || '>' || role) IN ('system>user', 'user>assistant', 'assistant>user') END, false))
    AND bool_or(after IS NULL AND role = 'assistant') AS valid
FROM states GROUP BY conv_id
"""

# the table of CRC-32 by its rule, and the unsigned CRC-32 of a text's UTF-8
_CRC_TABLE = (
    "crc_table AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY b) AS t "
    "FROM range(256) r(b))"
)


def _crc32_sql(x: str) -> str:
    byte = f"('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT"
    bytes_ = f"list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda i: {byte}))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), {_A_TO_Z}) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, k, {_crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM counted, crc_table),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), spots AS (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS d FROM spots),
wild AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS d FROM spots),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.d = b.d AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.d = b.word
), near AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
known AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)
), path AS (
  SELECT word, word AS root FROM known UNION ALL SELECT p.word, k.form FROM path p JOIN known k ON p.root = k.word WHERE k.form IS NOT NULL
), ends AS (SELECT p.word, p.root FROM path p JOIN known k ON p.root = k.word WHERE k.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)
"""


def _framed_sql(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_framed_sql(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _levels_sql(name: str, leaves: str) -> str:
    """Nodes (g, level, idx, size, digest) over leaves (g, idx, size, digest)."""
    return (
        f"{name} AS (SELECT g, 0 AS level, idx, size, digest FROM {leaves} UNION ALL "
        "SELECT g, level + 1, idx // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) "
        f"FROM {name} WHERE size > 1 GROUP BY g, level, idx // 3, size)"
    )


def _steps_sql(name: str, nodes: str) -> str:
    """(g, leaf, level, before, after): the siblings of each leaf's ancestor on each level below the top."""
    return (
        f"{name}_paths AS (SELECT g, idx AS leaf, 0 AS level, idx, size FROM {nodes} WHERE level = 0 UNION ALL "
        f"SELECT g, leaf, level + 1, idx // 3, (size + 2) // 3 FROM {name}_paths WHERE size > 1), "
        f"{name} AS (SELECT p.g, p.leaf, p.level, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < p.idx), '') AS before, "
        "coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > p.idx), '') AS after "
        f"FROM {name}_paths p JOIN {nodes} n ON n.g = p.g AND n.level = p.level AND n.idx // 3 = p.idx // 3 WHERE p.size > 1 GROUP BY ALL)"
    )


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, rows AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered
  FROM documents, crc_table
), ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS size FROM rows
), leaves AS (SELECT g, idx, size, leaf AS digest FROM ranked),
{_levels_sql("low", "leaves")},
tops AS (SELECT 0 AS g, g AS idx, count(*) OVER () AS size, digest FROM low WHERE size = 1),
{_levels_sql("high", "tops")},
{_steps_sql("low_steps", "low")},
{_steps_sql("high_steps", "high")},
steps AS (
  SELECT g, leaf AS idx, level, before, after FROM low_steps
  UNION ALL SELECT r.g, r.idx, 1000 + level, before, after FROM ranked r JOIN high_steps h ON h.leaf = r.g
), proofs AS (
  SELECT r.g, r.idx, coalesce(string_agg(before || after, '' ORDER BY level), '') AS proof, coalesce(list(before ORDER BY level) FILTER (level IS NOT NULL), []) AS befores, coalesce(list(after ORDER BY level) FILTER (level IS NOT NULL), []) AS afters
  FROM ranked r LEFT JOIN steps s ON s.g = r.g AND s.idx = r.idx GROUP BY r.g, r.idx
), folds AS (
  SELECT g, idx, 0 AS k, coalesce(tampered, leaf) AS digest FROM ranked
  UNION ALL SELECT f.g, f.idx, k + 1, sha256(befores[k + 1] || digest || afters[k + 1]) FROM folds f JOIN proofs p ON p.g = f.g AND p.idx = f.idx WHERE k < len(befores)
), ends AS (SELECT f.g, f.idx, f.digest AS folded_root FROM folds f JOIN proofs p ON p.g = f.g AND p.idx = f.idx WHERE f.k = len(p.befores)),
root AS (SELECT digest AS root FROM high WHERE size = 1)
SELECT r.doc_id, r.leaf, t.digest AS subroot, root.root, sha256(p.proof) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM ranked r JOIN tops t ON t.idx = r.g JOIN proofs p ON p.g = r.g AND p.idx = r.idx JOIN ends e ON e.g = r.g AND e.idx = r.idx, root
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_packing, op4_ngram_join, op5_decontamination, op6_quality, op7_chat, op8_language, op9_media, op10_token_counts, op11_pieces, op12_spelling, op13_merkle)}
ORACLES = {"op7_chat": OP7_SQL, "op12_spelling": OP12_SQL, "op13_merkle": OP13_SQL}
