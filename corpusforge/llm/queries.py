"""Registered queries of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import comparison, decontam, huffman, jaccard, langid, lexical, maxscore, merkle, secret_scan, sentpiece, suffix_array, suffix_tree, token_counts, warc
from .tables import read, start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its comparison SQL, if there is one."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            start(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; trained on the documents outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base matches and what the Markov models add."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit(secret_scan.samples(docs)))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), number("markov"),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


@query("op4_decontaminate", comparison.DECONTAMINATED)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    got = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_jaccard_join", comparison.JACCARD)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: 3-word shingles, similarity 0.9 or more."""
    return jaccard.cluster(read(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op6_sentencepiece_dropout")
def op6_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as ids with merge-dropout 0.1; digests of the ids and of the text that they decode to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = sentpiece.encode_table(docs, sentpiece.model_path(), dropout=0.1, seed=17)
    return got.select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", sentpiece.same_text(got).alias("lossless"))


@query("op7_huffman_ids")
def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as a Huffman archive in doc_id order and read back."""
    import public_tokenizers

    folder = scratch_path(spark, "huffman")
    huffman.write_documents(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.read_archive(spark, folder).select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


@query("op1_warc_assembly", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS best FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to FROM m""")
def op1_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back and assembled per capture."""
    folder = scratch_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.page_captures(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_maxscore_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
       FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""")
def op5_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows by integer inner product for every row whose id is divisible by 100."""
    rows = read(spark, sf_dir, "embeddings")
    return maxscore.search(rows, rows.where("vec_id % 100 = 0"), k=10)


@query("op8_suffix_tree_dedup", comparison.REPEATED_WORDS)
def op8_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside windows of 13 words that an earlier document has."""
    return suffix_tree.remove_repeats(read(spark, sf_dir, "documents"), size=13)


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside strings of 200 bytes that stand anywhere else."""
    return suffix_array.remove_repeats(read(spark, sf_dir, "documents"), size=200)


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, counted by the transducer of the model."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), model, limit=4096)


@query("op12_merkle_manifest", comparison.MERKLE)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document against the root of the manifest, some of them lower-cased after the fact."""
    return merkle.document_manifest(read(spark, sf_dir, "documents"))


@query("op13_lexical_search", comparison.LEXICAL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)
