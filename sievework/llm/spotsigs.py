"""SpotSigs document fingerprints, in DataFrame functions only.

Text is lower-cased and cut into words. Every common word (an anchor) starts a chain: the
anchor and the next two content words, passing over common words in between. The
fingerprint is the set of the chains' 64-bit hashes; its printable form is the number of
chains and an MD5 of the sorted set, so equal texts have equal fingerprints. A text
without a chain is its own single chain. Likeness is the Jaccard similarity of two sets;
sets fall into length classes, and a pair whose lengths alone rule out ``least`` is not
intersected at all.

The next document in the order of doc_id is found without one global window: ids are
range-partitioned and written out with their partition number, numbered within a
partition, and shifted by the rows of the partitions before. Texts are then dealt into
runs of 64 consecutive rows, each with a copy of the row that follows it.

Cost: ids are shuffled twice, texts twice (to meet their number, and into runs); every
run has at most 65 distinct rows, so no group grows with the input.

Cases: a null text counts as empty, with no words: its one chain is the empty text's.
Rows are ordered by doc_id, null first, then by a hash of the text; a repeated row is
followed by its repeat. A single row is followed by itself. An empty table gives no rows.
A very long text is one row with one set, and costs time in proportion. with_next() reads
doc_id and text and leaves other columns out; fingerprints() replaces columns that clash with
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import common

#: Common words of four languages; each may start a chain.
ANCHORS = (
    "a an the of and to in is was are be as at by for from it on or that this with not he she they have has had but his her their"
    " le la les un une de du des et est en que qui dans pour par sur au aux ce il elle ne pas se son sa ses avec ou plus"
    " der die das den dem ein eine und ist im von mit auf zu für nicht sich als auch es werden bei aus nach"
    " el los las una y es del al por con para su lo como más pero no sus"
).split()
RUN = 64


def _trie(words: list[str]) -> str:
    """A regular expression for the words that branches on one character at a time."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [c + _trie(rest) for c, rest in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return "" if not parts else (f"(?:{body})?+" if "" in words else body)


_A = _trie(sorted(set(ANCHORS)))
_SKIP = rf"(?: {_A}(?= ))*+"
CHAIN = rf"(?= {_A} )(?=( [^ ]+{_SKIP} [^ ]+{_SKIP} [^ ]+) )"
BETWEEN = rf"(?<=[^ \n]) {_A}(?= )"


def words_of(text):
    """' w1 w2 ... ' in lower case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def signatures(text):
    """Sorted distinct 64-bit hashes of the chains of a text column."""
    norm = words_of(text)
    found = F.regexp_extract_all(norm, F.lit(CHAIN), F.lit(1))
    bare = F.split(F.regexp_replace(F.array_join(found, "\n"), BETWEEN, ""), "\n")
    chains = F.when(F.size(found) > 0, bare).otherwise(F.array(F.trim(norm)))
    return F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c))))


def fingerprint(sigs):
    return F.concat_ws("-", F.size(sigs), F.md5(F.array_join(sigs.cast("array<string>"), ",").cast("binary")))


def length_class(sigs, least: float = 0.8):
    """Sets more than one class apart cannot reach ``least``."""
    return F.floor(F.log(F.size(sigs).cast("double")) / F.log(F.lit(1 / least)))


def likeness(a, b, least: float = 0.0):
    """Jaccard similarity; 0 where the lengths alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < large * least, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def numbered(docs: DataFrame) -> DataFrame:
    """_id, _h and _n: the place, from 0, of each distinct (doc_id, text) in their order."""
    keys = docs.select("_id", "_h").distinct()
    held = common.materialise(
        keys.repartitionByRange("_id", "_h").withColumn("_p", F.spark_partition_id()), "spotsigs-order"
    )
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_id", "_h"))
    return held.withColumn("_k", inside - 1).join(shift, "_p").select("_id", "_h", (F.col("_k") + F.col("_before")).alias("_n"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, next_text and next_sigs; text null as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": F.xxhash64("text")}
    )
    order = common.materialise(numbered(rows), "spotsigs-numbers")
    last = F.lit(order.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0])
    n = F.col("_n")
    run = F.floor(n / RUN)
    places = F.array(
        F.struct(run.alias("run"), n.alias("at"), F.lit(False).alias("copy")),
        F.when(n == 0, F.struct(F.floor(last / RUN).alias("run"), (last + 1).alias("at"), F.lit(True).alias("copy"))).when(
            n % RUN == 0, F.struct((run - 1).alias("run"), n.alias("at"), F.lit(True).alias("copy"))
        ),
    )
    dealt = (
        rows.join(order, ["_id", "_h"])
        .select("doc_id", "text", F.explode(F.array_compact(places)).alias("_to"))
        .select("doc_id", "text", "_to.*")
        .repartition("run")
        .withColumn("sigs", signatures(F.col("text")))
    )
    w = Window.partitionBy("run").orderBy("at", "copy")
    return (
        dealt.withColumns({"next_text": F.lead("text").over(w), "next_sigs": F.lead("sigs").over(w)})
        .filter("not copy")
        .select("doc_id", "text", "sigs", "next_text", "next_sigs")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs plus sigs, fingerprint and length_class."""
    kept = [c for c in docs.columns if c.lower() not in {"sigs", "fingerprint", "length_class"}]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], signatures(F.col("text")).alias("sigs"))
    return out.withColumns({"fingerprint": fingerprint(F.col("sigs")), "length_class": length_class(F.col("sigs"))})


def query(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(common.table(spark, sf_dir, "documents"))
    edited = (
        pairs.withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, int(length(text) div 2))")))
        .withColumn("edited_sigs", signatures(F.col("edited")))
    )
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
