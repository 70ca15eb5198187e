"""Similarity-hash bit fingerprints of texts, shared by problems 3 and 5.

A text's set of word sequences gives VALUES hash minima, each of which two texts share
with the probability of their similarity. BITS bits of each minimum make the code, of
VALUES x BITS = 2,016 bits: near texts differ in few of them, others in about half. The
code is all that candidates are found by: it is cut into BLOCKS slices of ROWS x BITS =
48 bits, slices are joined by equality, and codes must lie within the Hamming RADIUS.

With the defaults a pair at similarity 0.6 shares no slice with probability
(1 - 0.6**3)**42 = 4e-5, and at 0.7 with 4e-8. Its code differs in 403 bits with a
deviation of 46; RADIUS is 5 deviations above. Unrelated texts differ in 900 bits and
more. Every pair that is found is verified on the texts' whole sets of sequences.

Every pair of texts that share a slice meets, however many texts share it. `finer` splits
a slice by further slices of the code; it loses pairs and isn't used for candidates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS, ROWS, BITS = 42, 3, 16
VALUES, SLICE_BITS = BLOCKS * ROWS, ROWS * BITS
CODE_BITS = VALUES * BITS
CODE_WORDS = -(-CODE_BITS // 64)
RADIUS = 640
#: Slices that `finer` splits by.
SPLITS = 8
#: Pairs of one text from which on its row is spread over several keys when texts are verified.
HUB_PAIRS = 5_000
#: Codes of repeated texts that a worker remembers; bounds its memory only.
REMEMBERED_CODES = 20_000
#: Word hashes that a worker remembers; bounds its memory only.
REMEMBERED_WORDS = 300_000

MULTIPLIERS = np.random.default_rng(20_26).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = np.random.default_rng(11_26).integers(0, 2**63, VALUES, dtype=np.uint64)
MARKS = re.compile("[̀-ͯ҃-֑҇-ֽً-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
WORDS = re.compile("[a-z0-9]+")


def user_text(messages: str = "messages") -> Column:
    """The first user message after its first line; null without one, empty without a second line."""
    users = F.filter(F.col(messages), lambda m: (m["role"] == "user") & m["content"].isNotNull())
    content = F.try_element_at(users, F.lit(1))["content"]
    at = F.locate("\n", content)
    return F.when(at > 0, F.substr(content, at + 1)).otherwise(F.when(content.isNotNull(), F.lit("")))


def words_of(text: str) -> list[str]:
    """Longest runs of a-z and 0-9, in lower case, without accents."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFD", text.lower()))
    return WORDS.findall(text.lower())


class Sketcher:
    """Sets of hashed word sequences, and their fingerprints."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def sequences(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the sequences of `width` words."""
        if not text:
            return np.empty(0, np.uint64)
        words = words_of(text)
        n = len(words) - self.width + 1
        if n < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        s = np.zeros(n, np.uint64)
        for k in range(self.width):
            s = (s ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        return np.unique(s)


def minima(sequences: np.ndarray) -> np.ndarray:
    """VALUES hash minima of a set, 4,096 members at a time."""
    out = np.full(VALUES, 2**64 - 1, np.uint64)
    for a in range(0, len(sequences), 4096):
        hashed = sequences[a : a + 4096, None] * MULTIPLIERS + OFFSETS
        np.minimum(out, hashed.min(axis=0), out=out)
    return out


def code_of(low: np.ndarray) -> np.ndarray:
    """The code as CODE_WORDS words of 64 bits, the first bit highest; the last word is filled up with zeros."""
    mixed = low ^ low >> np.uint64(31)
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    raw = (mixed & np.uint64(2**BITS - 1)).astype(">u2").tobytes()
    return np.frombuffer(raw.ljust(8 * CODE_WORDS, b"\0"), ">u8").astype(np.uint64)


def slices(code: str = "code") -> Column:
    """ARRAY<BIGINT> of the BLOCKS slices of a code, each with its number above its bits."""

    def one(k: int) -> Column:
        j, off = divmod(SLICE_BITS * k, 64)
        room = 64 - off - SLICE_BITS  # bits of word j to the right of the slice; negative: the slice goes on in the next word
        word = F.col(code)[j]
        if room >= 0:
            bits = F.shiftrightunsigned(word, room)
        else:
            bits = F.shiftleft(word, -room).bitwiseOR(F.shiftrightunsigned(F.col(code)[j + 1], 64 + room))
        return bits.bitwiseAND(F.lit(2**SLICE_BITS - 1)).bitwiseOR(F.lit(k << SLICE_BITS))

    return F.array(*map(one, range(BLOCKS)))


def slice_rows(reps: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., k INT, block BIGINT): one row for each slice of each code."""
    return reps.select(*keep, F.posexplode(slices()).alias("k", "block"))


def finer(members: DataFrame, codes: DataFrame, id_: str) -> DataFrame:
    """Members (id_, k, level, block, ...) of hot blocks in subcells, by the SPLITS slices that follow slice k + SPLITS x level."""
    coded = members.join(codes.select(id_, slices().alias("_s")), id_)
    at = lambda p: F.pmod(F.col("k") + F.col("level") * SPLITS + p, F.lit(BLOCKS))
    sub = F.transform(F.sequence(F.lit(1), F.lit(SPLITS)), lambda p: F.xxhash64("block", F.get("_s", at(p))))
    return coded.withColumn("block", F.explode(sub)).withColumn("level", F.col("level") + 1).drop("_s")


def keyed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., sig BINARY, text) of the rows with a text; sig is the text's digest, which stands for all its copies."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*keep, F.unhex(F.md5(text)).alias("sig"), F.col(text).alias("text"))


def sketch(df: DataFrame, keep: list[str], text: str, width: int = 3) -> DataFrame:
    """(keep..., code ARRAY<BIGINT>), one row for each row whose text has a sequence of `width` words.

    keep[0] is the text's digest: copies that a task meets again are not read again.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Sketcher(width), {}
        for part in parts(batches):
            rows, codes = [], []
            for k, (sig, t) in enumerate(zip(part.column(0).to_pylist(), part.column(len(keep)).to_pylist())):
                if sig not in known:
                    if len(known) >= REMEMBERED_CODES:
                        known.clear()
                    s = own.sequences(t)
                    known[sig] = code_of(minima(s)) if len(s) else None
                if (code := known[sig]) is not None:
                    rows.append(k)
                    codes.append(code)
            if rows:
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in range(len(keep))), lists(codes)], names=[*keep, "code"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, code array<bigint>")


def sequence_sets(df: DataFrame, keep: list[str], text: str, width: int = 3) -> DataFrame:
    """(keep..., seqs ARRAY<BIGINT>): the distinct hashed sequences of each text."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketcher(width)
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists([own.sequences(t) for t in part.column(len(keep)).to_pylist()])], names=[*keep, "seqs"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, seqs array<bigint>")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays).view(np.int64)))


def verified(pairs: DataFrame, a: str, b: str, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b, similaridade) of the pairs of digests whose texts' whole sets of sequences are that similar.

    texts: sig, text, copies included. Only texts that are in a pair are read as sets; the
    set of a text with HUB_PAIRS pairs or more is spread over keys of that many pairs.
    """
    pairs = pairs.checkpoint()
    each = pairs.select(F.col(a).alias("sig")).unionByName(pairs.select(F.col(b).alias("sig")))
    used = each.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("_salts"))
    own = texts.select("sig", "text").join(used, "sig").groupBy("sig").agg(F.first("text").alias("text"), F.first("_salts").alias("_salts"))
    sets = sequence_sets(own, ["sig", "_salts"], "text", width).checkpoint()  # both sides of a pair read it
    salted = sets.select("sig", "seqs", "_salts", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    hubs = sets.where("_salts > 1").select("sig", "_salts")
    both = pairs
    for side, other, seqs in ((a, b, "_x"), (b, a, "_y")):
        many = hubs.select(F.col("sig").alias(side), F.col("_salts").alias("_n"))
        both = both.join(many, side, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
        both = both.join(salted.select(F.col("sig").alias(side), "_salt", F.col("seqs").alias(seqs)), [side, "_salt"]).drop("_salt")
    return both.withColumn("similaridade", jaccard("_x", "_y")).where(F.col("similaridade") >= similarity).select(a, b, "similaridade")


def unpacked(code: str, prefix: str) -> list[Column]:
    """The words of a code as columns of their own, so that `hamming` is plain arithmetic (JVM, whole-stage codegen)."""
    return [F.coalesce(F.col(code)[k], F.lit(0)).alias(f"{prefix}{k}") for k in range(CODE_WORDS)]


def hamming(a: str, b: str) -> Column:
    """Bits in which two unpacked codes differ."""
    terms = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(CODE_WORDS)]
    return sum(terms[1:], terms[0])


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both).cast("double")
