"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

A word's symbols stand in a linked list; a heap holds the rank of each adjacent pair. The lowest rank (leftmost on
ties) is popped and merged until the heap is empty; the count is the initial symbols minus the merges. Words repeat,
so that each worker keeps counts of short words it has seen, in a table of bounded size.

Cases: null and empty texts have no bytes and no tokens; special strings in a text count as one token each, as the
library does by default; a word of any length is merged whole; repeated rows stay; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import small_batches

TOKENIZER_FILE = "word_bpe_49k.json"
LIMIT = 2048
_CACHED_WORDS, _CACHED_LENGTH = 400_000, 48
# Unicode white space, as the vocabulary's own patterns mean it.
WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BLANK = re.compile(f"[{WHITE}]+")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_WIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    keep = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(moved)) for b in range(256)]


class WordCounter(dict):
    """word -> tokens, filled as words are asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, self.special))).split if self.special else None

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, raw: bytes) -> int:
        inner, ranks = self.inner, self.ranks
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, new = heapq.heappop(heap)
            left = ids[i]
            if left is None or (j := after[i]) >= n:
                continue
            found = ranks.get((left, ids[j]))
            if not found or found[1] != new:  # the pair has changed since it was pushed
                continue
            ids[i], ids[j] = new, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
            count -= 1
        return count

    def count(self, text: str) -> int:
        if "<|" in text and self.split and any(s in text for s in self.special):
            parts = self.split(text)
            return len(parts) - 1 + sum(map(self._count, parts))
        return self._count(text)

    def _count(self, text: str) -> int:
        if text.isascii():
            found = _PLAIN.findall(text.lower())
        else:
            text = _BLANK.sub(" ", unicodedata.normalize("NFC", text))
            if "Σ" in text:  # letters are lower-cased one by one: no final sigma
                text = text.replace("Σ", "σ")
            found = _WIDE.findall(text.lower())
        return sum(map(self.__getitem__, found))


@lru_cache(maxsize=2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row. path: a byte-level BPE file with word ends."""
    path = path or tokenizer_path()
    def run(batches):
        counter = _counter(path)
        for batch in batches:
            counts = [counter.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["k", "b", "t"])

    small_batches(docs.sparkSession)
    slim = docs.select(
        F.col(key).alias("k"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("b"),
        F.col(text).cast("string").alias("s"),
    )
    return slim.mapInArrow(run, f"k {slim.schema['k'].dataType.simpleString()}, b bigint, t bigint").select(
        F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("t").alias("n_tokens"), (F.col("t") > limit).alias("over_limit")
    )


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
