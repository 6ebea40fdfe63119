"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

A text is cut into overlapping chunks. The chunks are pre-tokenised in parallel; where the
pre-token boundaries of two neighbours coincide inside their overlap, the chunks are stitched, and
the pieces between the stitches are encoded in parallel. Neighbours whose boundaries never
coincide (an unbroken run longer than the overlap) are encoded as one piece: such a run is one
pre-token, which can't be encoded in parts, so a piece is as long as the longest pre-token at most.
A text of at most one chunk is one piece and never leaves its partition.

null and empty texts have the empty list; blank texts are encoded as they are. Special tokens are
ordinary text. Decoding joins the tokens' raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A scan's tokens that end this close to the end of its chunk may depend on what follows.
MARGIN = 4
#: Characters of a chunk and of its overlap with the next; chunks that are handed on at once.
CHUNK, OVERLAP, CUT_AT_ONCE = 1_024, 128, 4_096


class Vocabulary:
    """The rank file, broadcast once; each Python worker builds its encoder once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        # any file system; under 2 MB for every public vocabulary
        local = "://" not in path
        rows = [] if local else spark.read.format("binaryFile").load(path).select("content").take(1)
        if local:
            with open(path, "rb") as f:
                rows = [(f.read(),)]
        self.data = spark.sparkContext.broadcast(bytes(rows[0][0]))
        self._encoder = None

    def __getstate__(self) -> dict:
        return {"data": self.data, "_encoder": None}

    def encoder(self):
        if self._encoder is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.data.value.splitlines() if line)}
            self._encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._encoder

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            return self.encoder().encode_ordinary(text)
        except BaseException as e:
            # the fast scanner's stack overflows on very long runs of white space
            if type(e).__name__ != "PanicException":
                raise
            return self.encode_slowly(text)

    def encode_slowly(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        for piece in regex.findall(PATTERN, text):
            out.extend(self.encoder()._encode_single_piece(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.encoder().decode_bytes([int(i) for i in ids]).decode("utf-8", errors="replace")


def scan_boundaries(text: str, base: int, low: int, high: int) -> list[int]:
    """Token ends p of a scan of text (which begins at base), low <= p <= high, fit for a stitch.

    Only ends after a letter or digit and before something else: such an end bounds a pre-token in
    every scan, and encoding up to it gives the same tokens as encoding the whole.
    """
    import regex

    out = []
    for m in regex.finditer(PATTERN, text):
        e = m.end()
        if base + e > high:
            break
        if base + e >= low and e < len(text) and text[e - 1].isalnum() and not text[e].isalnum():
            out.append(base + e)
    return out


def _encode_long(df: DataFrame, vocabulary: Vocabulary, chunk: int, overlap: int, keep: list[str]) -> DataFrame:
    numbered = df.withColumn("__uid", F.monotonically_increasing_id()).select(*keep, "__uid", "__text")
    own = [f for f in numbered.schema.fields if f.name != "__text"]

    def cut_up(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rest = pdf.drop(columns="__text")
            at: list[int] = []
            i: list[int] = []
            t: list[str] = []
            for k, text in enumerate(pdf["__text"]):
                for s in range(0, len(text), chunk):
                    at.append(k)
                    i.append(s // chunk)
                    t.append(text[s : s + chunk + overlap])
                    if len(at) == CUT_AT_ONCE:
                        yield rest.iloc[at].reset_index(drop=True).assign(i=i, t=t)
                        at, i, t = [], [], []
            if at:
                yield rest.iloc[at].reset_index(drop=True).assign(i=i, t=t)

    rows = numbered.mapInPandas(cut_up, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", i int, t string")
    # spread the chunks of one text over all tasks
    rows = rows.repartition("__uid", "i")

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            head, tail = [], []
            for i, t in zip(pdf["i"], pdf["t"]):
                s = i * chunk
                ends = scan_boundaries(t, s, s, s + len(t) - MARGIN)
                head.append([p for p in ends if p < s + overlap])
                tail.append([p for p in ends if p >= s + chunk])
            yield pdf.assign(head=head, tail=tail)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    scanned = rows.mapInPandas(scan, f"{kinds}, head array<int>, tail array<int>")
    over = W.partitionBy("__uid").orderBy("i")
    meet = F.array_min(F.array_intersect(F.lag("tail").over(over), F.col("head")))
    cut = scanned.withColumn("a", F.when(F.col("i") == 0, 0).otherwise(meet)).drop("head", "tail")
    cut = cut.withColumn("g", F.sum(F.when(F.col("a").isNotNull(), 1).otherwise(0)).over(over))
    # a group's chunks without their overlap, then the last one with it
    group = cut.groupBy("__uid", "g").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("ts"), F.max("a").alias("a"), *[F.first(k, True).alias(k) for k in keep])
    whole = F.concat(F.array_join(F.transform(F.slice("ts", 1, F.size("ts") - 1), lambda x: F.substring(x["t"], 1, chunk)), ""), F.element_at("ts", -1)["t"])
    following = F.lead("a").over(W.partitionBy("__uid").orderBy("g"))
    first = F.col("ts")[0]["i"] * chunk
    size = F.coalesce(following - F.col("a"), F.lit(2_147_483_647))
    pieces = group.select(*keep, "__uid", "g", F.substring(whole, F.col("a") - first + 1, size).alias("t")).repartition("__uid", "g")

    @F.pandas_udf("array<int>")
    def encode(t: pd.Series) -> pd.Series:
        return t.map(vocabulary.encode)

    coded = pieces.withColumn("ids", encode("t"))
    joined = coded.groupBy("__uid").agg(F.array_sort(F.collect_list(F.struct("g", "ids"))).alias("p"), *[F.first(k, True).alias(k) for k in keep])
    return joined.select(*keep, F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def encode_corpus(df: DataFrame, *, text: str = "text", keep: list[str], vocabulary_path: str = DEFAULT_VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keep columns and ids (array of int) of every row, repeated rows included."""
    if not 0 < overlap * 2 <= chunk:
        raise ValueError("the overlap must be at most half a chunk")
    vocabulary = Vocabulary(df.sparkSession, vocabulary_path)
    rows = df.select(*keep, F.col(text).alias("__text"))

    @F.pandas_udf("array<int>")
    def encode(t: pd.Series) -> pd.Series:
        return t.map(vocabulary.encode)

    long = F.length("__text") > chunk
    short = rows.where(~F.coalesce(long, F.lit(False))).select(*keep, encode(F.coalesce("__text", F.lit(""))).alias("ids"))
    return short.unionByName(_encode_long(rows.where(long), vocabulary, chunk, overlap, keep))


def decode_ids(spark: SparkSession, ids: Column, vocabulary_path: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a list of ids; bytes that are no UTF-8 become U+FFFD; null stays null."""
    vocabulary = Vocabulary(spark, vocabulary_path)

    @F.pandas_udf("string")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else vocabulary.decode(v))

    return decode(ids)
