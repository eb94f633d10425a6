"""Token counts: batch encoding in Arrow functions that return lengths only.

A vocabulary that drops white space never joins what stands on both sides of it into one token: texts are cut there into
segments, longer ones also where the vocabulary's rules part letters from what follows. A segment has as many tokens in
a text as alone, so a task encodes each one that it has not met, in batches of even bytes, and adds up lengths. Texts
are as long as they come: what one call of the library holds depends on the batch's bytes, not on the text.
Vocabularies that keep white space count whole texts, in the same batches.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_or_empty

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of a batch that one call of the library encodes; only a longer segment without a safe boundary goes beyond.
BATCH = 1 << 16
#: Segments up to SHORT bytes are remembered, up to HELD of them at a time; those above LONG bytes are cut further.
SHORT, HELD, LONG = 48, 1 << 19, 4096
#: Rows of an Arrow batch whose segments are looked up together.
ROWS = 256
#: Letters and marks are tokens of their own, so a text may be cut between an ASCII letter and a mark that no special
#: token has and that no letter is composed with.
MARKS = re.compile(rb"(?<=[A-Za-z])(?=[.,:;!?)])")
#: Where long segments may be cut too: before an ASCII digit, as each is a token of its own, and between an ideograph
#: and its full stop or comma.
INSIDE = re.compile(r"(?=[0-9])|(?<=[一-鿿])(?=[、。，])")


def drops_space(spec: dict) -> bool:
    """Whether a vocabulary's rules keep only matches of a pattern that white space is no part of, digits one by one."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, names = steps[0], [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = first.get("pattern", {}).get("Regex", "")
    marked = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
    return kept and names == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not marked and not spec.get("post_processor")


@functools.cache
def library(vocabulary: str = TOKENIZER) -> tuple[Callable[[list[str]], list], bool]:
    """A function from texts to their encodings (their length is the number of tokens), and whether texts may be cut."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    path = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1), False
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    with open(path, encoding="utf-8") as spec:
        cuts = drops_space(json.load(spec))
    return lambda texts: whole.encode_batch(texts, add_special_tokens=False), cuts


def balanced(texts: list[bytes], size: int = BATCH) -> Iterator[list[int]]:
    """The numbers of the texts, longest first, in batches of about `size` bytes."""
    part, used = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if part and used + len(texts[i]) > size:
            yield part
            part, used = [], 0
        part.append(i)
        used += len(texts[i]) + 1
    if part:
        yield part


def segments(data: bytes) -> list[bytes]:
    """What stands between ASCII white space and before marks; long segments in parts that have as many tokens as the whole."""
    out = MARKS.sub(b" ", data).split()
    if len(data) > LONG and max(map(len, out), default=0) > LONG:
        out = [p for s in out for p in ([x.encode() for x in INSIDE.split(s.decode()) if x] if len(s) > LONG else [s])]
    return out


class Counter:
    """Counts tokens of texts and remembers short segments."""

    def __init__(self, vocabulary: str = TOKENIZER):
        self.encode, self.cuts = library(vocabulary)
        self.known: dict[bytes, int] = {}

    def alone(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of each text."""
        out = [0] * len(texts)
        for part in balanced(texts):
            for i, e in zip(part, self.encode([texts[i].decode() for i in part]), strict=True):
                out[i] = len(e)
        return out

    def joined(self, parts: list[bytes]) -> dict[bytes, int]:
        """The number of tokens of each segment. A batch is one text; tokens belong to the segment that they start in."""
        out: dict[bytes, int] = {}
        for numbers in balanced(parts):
            texts = [parts[i].decode() for i in numbers]
            found = self.encode([" ".join(texts)])[0].offsets
            starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
            at = np.searchsorted(np.fromiter((a for a, _ in found), np.int64, len(found)), starts)
            out.update(zip((parts[i] for i in numbers), np.diff(at).tolist(), strict=True))
        return out

    def __call__(self, texts: list[bytes]) -> list[int]:
        if not self.cuts:
            return self.alone(texts)
        parts = [segments(t) for t in texts]
        if len(self.known) > HELD:
            self.known.clear()
        new = self.joined(list(set().union(*parts) - self.known.keys()))
        long = {s: n for s, n in new.items() if len(s) > SHORT}
        self.known.update(new)
        out = [sum(map(self.known.__getitem__, p)) for p in parts]
        for s in long:
            del self.known[s]
        return out


@functools.cache
def counter(vocabulary: str) -> Counter:
    """One for all tasks of a worker process."""
    return Counter(vocabulary)


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (more than `limit` tokens) for every row, in one pass without a shuffle.

    No begin, end or other added token; strings of special tokens in a text count as the library takes them by default.
    Null and empty texts have 0 bytes and 0 tokens. Keys of any type come back as they are, nulls too; equal rows give
    equal rows. Other columns play no part, whatever their names. No rows: none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counted(texts), pa.int64())], ["_key", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    found = rows.mapInArrow(count, f"_key {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_tokens(spark, sf_dir):
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))
