"""The operators applied to the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.llm import (
    fingerprints,
    id_files,
    jaccard_join,
    language_id,
    licenses,
    merkle,
    mixing,
    nearest,
    packing,
    private_data,
    repeats,
    token_counts,
    whitening,
)
from labtables.llm._common import table
from labtables.session import scratch_dir

#: Vocabulary files are found by the installed package; other files may be passed.
PACKED_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
STORED_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
COUNTED_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.find(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to the root of their sizes; slot and place give the order."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.tempered(mixing.source_sizes(docs)))
    return mixed.select("doc_id", "source", "__mix.block", "__mix.slot", "__mix.place")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), PACKED_VOCABULARY, end_id=0)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "ids")
    docs = table(spark, sf_dir, "documents")
    dictionary, files = id_files.write_ids(docs, folder, STORED_VOCABULARY, end_id=1)
    return id_files.read_ids(spark, folder, dictionary, files)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learning_sample(docs))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows claim one character more than they have; their proofs do not lead to the root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    claim = merkle.leaf("doc_id", "source", "lang", n_chars, "text")
    proofs = merkle.manifest(docs.withColumn("claim", claim), fields, "lang", "doc_id", keep=["claim"])
    found = proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        merkle.folded("claim").alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), COUNTED_VOCABULARY)


def _merkle_sql() -> str:
    """The trees level by level."""

    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(field(n) for n in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    # The checksum bit by bit, as the engine has no function for it.
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
          lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
    return f"""
        WITH RECURSIVE leaves AS (SELECT *, {leaf('n_chars')} AS leaf, {leaf('(n_chars + 1)')} AS changed,
            coalesce(xor({crc}, 4294967295) % 7 = 0, false) AS tampered FROM documents),
        start AS (SELECT *, coalesce('1' || lang, '0') AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        low AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM start
          UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2,
            sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 2, n),
        tops AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
        high AS (SELECT 0 AS level, i, n, subroot AS h FROM tops
          UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high
            WHERE n > 1 GROUP BY level, i // 2, n),
        walk AS (SELECT doc_id, tree, i AS leaf_no, 0 AS level, i, n, '' AS proof, CASE WHEN tampered AND n_chars IS NOT NULL
            THEN changed ELSE leaf END AS folded FROM start
          UNION ALL SELECT w.doc_id, w.tree, leaf_no, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''),
            sha256(CASE WHEN w.i % 2 = 0 THEN folded || coalesce(s.h, '') ELSE s.h || folded END)
          FROM walk w LEFT JOIN low s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
        up AS (SELECT w.doc_id, w.tree, leaf_no, subroot, 0 AS level, t.i, t.n, proof, folded
            FROM walk w JOIN tops t ON w.tree = t.tree WHERE w.n = 1
          UNION ALL SELECT u.doc_id, u.tree, leaf_no, subroot, u.level + 1, u.i // 2, (u.n + 1) // 2, proof || coalesce(s.h, ''),
            sha256(CASE WHEN u.i % 2 = 0 THEN folded || coalesce(s.h, '') ELSE s.h || folded END)
          FROM up u LEFT JOIN high s ON s.level = u.level AND s.i = xor(u.i, 1) WHERE u.n > 1)
        SELECT u.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM up u JOIN start s ON s.tree = u.tree AND s.i = u.leaf_no, (SELECT h AS root FROM high WHERE n = 1) WHERE u.n = 1
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_private_data,
        op2_mixing,
        op3_packing,
        op4_repeats,
        op5_licenses,
        op6_nearest,
        op7_id_files,
        op8_fingerprints,
        op9_language,
        op10_jaccard_join,
        op11_whitening,
        op12_merkle,
        op13_token_counts,
    )
}
# Said in SQL where the whole result can be; the other operators add what their methods find
# (spans, labels, order, places, components of either sign), and tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op4_repeats": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
          FROM documents),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        k AS (SELECT doc_id, words[i] AS word, i,
            CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(words[i : i + 49], ' ')) END AS run FROM i),
        f AS (SELECT *, CASE WHEN run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id THEN i END AS bad FROM k),
        c AS (SELECT doc_id, word, i, coalesce(i - max(bad) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone FROM f),
        d AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
            string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
          sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN d ON w.doc_id = d.doc_id
    """,
    "op12_merkle": _merkle_sql(),
}
