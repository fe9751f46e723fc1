"""Token counts through a digest cache.

The cache is a parquet table of (tokenizer digest, content digest, n_tokens). A text's content
digest is the SHA-256 of its UTF-8 bytes after null has become the empty text; the tokenizer's
is the SHA-256 of its file, so another version of the file never meets old counts. The cache is
partitioned by tokenizer and by the digest's first bits. Digests alone are joined to it; only texts
that it lacks are moved, one of each is encoded, and the new counts are appended. Copies collapse
map side, before the shuffle, so a text that fills a third of the table is encoded once and moved
once per task. A digest that two writers append at the same time is read as one row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import id_text, process_cache, scratch_root

LIMIT = 512
#: Texts longer than this many characters are encoded one by one, others in batches.
LONG_TEXT = 100_000
BATCH = 64
#: Partitions of the cache's digests.
PARTS = 16
#: Up to so many missing digests (16 MB) are sent to the tasks, so that only their texts are moved.
BROADCAST_DIGESTS = 500_000
CACHE = "digest binary, n_tokens long, tokenizer string, part int"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: Characters on which every engine's letter, digit and space classes agree.
_SAFE = re.compile(r"[\t\n\r -~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*")
#: Fixed value: how byte-level encoders cut a text into pieces.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Counter:
    """Token counts of one tokenizer file.

    A plain byte-level BPE file also gets a faster encoder built from its own merges; that one
    takes the texts made of _SAFE characters without special strings, on which both agree.
    """

    def __init__(self, path: str):
        self.fast, self.special = None, ()
        if not path.endswith(".json"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.slow = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if plain and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True):
            import tiktoken

            names = _byte_names()
            ranks = {bytes([b]): b for b in range(256)}
            for merge in model["merges"]:
                left, right = merge if isinstance(merge, list) else merge.split(" ")
                ranks.setdefault(bytes(names[c] for c in left + right), len(ranks))
            self.fast = tiktoken.Encoding("merges", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
            self.special = tuple(t["content"] for t in spec.get("added_tokens", ()))

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast and _SAFE.fullmatch(text) and not any(s in text for s in self.special):
                out[i] = len(self.fast.encode_ordinary(text))
            else:
                rest.append(i)
        if rest:
            for i, n in zip(rest, self.slow([texts[i] for i in rest]), strict=True):
                out[i] = n
        return out


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the file's library gives them, without added special tokens."""
    loaded = process_cache("tokenizers")
    if path not in loaded:
        loaded[path] = _Counter(path)
    return loaded[path](texts)


def _encode(path: str):
    def run(batches):
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            group: list[str] = []
            for x in [*texts, None]:
                if group and (x is None or len(group) == BATCH or len(x) > LONG_TEXT):
                    counts += count_tokens(group, path)
                    group = []
                if x is not None:
                    group.append(x)
                    if len(x) > LONG_TEXT:
                        counts += count_tokens(group, path)
                        group = []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def refresh(docs: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """Encode what the cache lacks, append it, and return digest, n_tokens of this tokenizer, a row for each digest."""
    spark = docs.sparkSession
    common.prepare(spark)
    version = tokenizer_digest(tokenizer)

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE).option("mergeSchema", "false").parquet(cache_path).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    filled = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    text = F.coalesce("text", F.lit(""))
    rows = id_text(docs).select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    if filled:
        missing = common.cut(rows.select("digest").distinct().join(cached().select("digest"), "digest", "left_anti"), "missing")
        n = missing.count()
        if not n:
            return cached()
        rows = rows.join(F.broadcast(missing) if n <= BROADCAST_DIGESTS else missing, "digest", "left_semi")
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    counted = distinct.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    part = F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int")
    counted.select("digest", "n_tokens", F.lit(version).alias("tokenizer"), part.alias("part")).write.partitionBy("tokenizer", "part").mode("append").parquet(cache_path)
    return cached()


def token_counts(docs: DataFrame, cache_path: str | None = None, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Without a cache_path the cache is a fresh table of this call. A null text counts as empty
    (0 bytes, 0 tokens). Very long texts are encoded whole, one at a time. Repeated rows and rows
    with a null doc_id are counted like any other; an empty table gives an empty result; further
    columns of docs are ignored, whatever their names.
    """
    tokenizer = tokenizer or default_tokenizer()
    cache_path = cache_path or f"{scratch_root(docs.sparkSession)}/token-cache-{uuid.uuid4().hex[:12]}"
    counts = refresh(docs, cache_path, tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = id_text(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
