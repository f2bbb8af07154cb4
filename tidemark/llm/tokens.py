"""Token counts through a digest cache: each distinct text is encoded once per tokenizer version."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import forget_later, shared_dir, store, table

LIMIT = 1024
#: Characters of scripts whose letters, digits and spaces all Unicode versions in use agree on; other texts go to the library whole.
SETTLED = r"[\x00-ɏΑ-ΡΣ-ώА-я‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥]*"
#: Runs of so many characters of one class go to the library: the faster encoder's splitter recurses on them.
LONG_RUN = 50_000
#: Fixed value: the splitting pattern of byte-level BPE tokenizers with use_regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_version(path: str) -> str:
    """Names a tokenizer by the content of its file, so that a changed file never meets old counts."""
    with open(path, "rb") as f:
        return f"{os.path.basename(path)}:{hashlib.sha256(f.read()).hexdigest()[:16]}"


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks if the file is plain byte-level BPE, whose merges are in the order of the ids they make; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and spec.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    special = {x["content"] for x in spec.get("added_tokens", [])}
    letters = _byte_letters()
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in letters for t in vocab for c in t):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    singles = sorted(i for t, i in vocab.items() if len(t) == 1)
    if made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 != len(vocab) or singles != list(range(256)):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items()}


@lru_cache(4)
def counter(path: str) -> Callable[[str], int]:
    """The token count of one text as the file's own library gives it, without added begin or end tokens."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text))
    if not path.endswith(".json"):
        raise ValueError(f"no tokenizer library for {path}")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def whole(text: str) -> int:
        return len(library.encode(text, add_special_tokens=False).ids)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _as_ranks(spec)
    if ranks is None:
        return whole
    # The same merges in a faster encoder; texts with added-token strings or unsettled characters keep to the library.
    fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    settled = regex.compile(SETTLED)
    run = regex.compile(rf"\s{{{LONG_RUN},}}|\p{{L}}{{{LONG_RUN},}}|\p{{N}}{{{LONG_RUN},}}|[^\s\p{{L}}\p{{N}}]{{{LONG_RUN},}}")
    added = [x["content"] for x in spec.get("added_tokens", [])]

    def count(text: str) -> int:
        if settled.fullmatch(text) is None or any(x in text for x in added) or len(text) >= LONG_RUN and run.search(text):
            return whole(text)
        try:
            return len(fast.encode_ordinary(text))
        except BaseException as e:  # noqa: BLE001 - the encoder's own panics are no Exception
            if type(e).__name__ != "PanicException":
                raise
            return whole(text)

    return count


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["digest", "n_tokens"])

    return run


CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; a digest that concurrent runs both added counts once."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, *, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.

    docs: doc_id, text (more columns are ignored). ``tokenizer`` is a .json or
    .model file that every executor can open; ``cache`` a folder on shared
    storage with (digest, n_tokens) by tokenizer version. The content key is the
    SHA-256 of the text: no other normalisation leaves counts as they are.

    1. Digests only: each document's digest, one representative each.
    2. Distinct digests without a stored count are the misses.
    3. The misses' texts join by (doc_id, digest) of the representative, whose
       keys are distinct, so many copies of a text are no hot key; each is
       encoded once (once per row where whole rows repeat) and appended.
    4. Documents join the stored counts by digest.

    A null text counts as empty (0 bytes, 0 tokens). Texts may be of any length;
    long runs of one class of characters are counted by the library itself. Repeated rows each return.
    A null doc_id is kept. An empty table gives an empty result and appends
    nothing. A failed run appends nothing; tasks that run again write the same rows.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    keyed = store(keyed, "digests")
    known = cached_counts(spark, cache, version)
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # From files the number of misses is known: few are broadcast, and texts whose counts are all stored aren't shuffled.
    wanted = store(firsts.join(known, "digest", "left_anti").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_want")), "misses")
    texts = docs.select(F.col("doc_id").alias("_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    found = texts.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_want"))).select("digest", "text")
    fresh = found.mapInArrow(_counted(tokenizer), "digest binary, n_tokens bigint")
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a repeated row is encoded with its twin, but stored once
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    counts = store(cached_counts(spark, cache, version), "counts")  # from files, so that a frequent digest's partition can be split
    joined = keyed.join(counts, "digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """A cache of its own for each call: every distinct text of the table is a miss once."""
    import uuid

    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    forget_later(spark, cache)
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
