"""SpotSigs document fingerprints, in DataFrame and SQL functions only.

A text is lower-cased and read as words (runs of letters, digits and marks).
Anchors are common words of four languages and the start of each line. The
signature of an anchor is the chain of the next three content words (words that
are no common words) after it; chains end with the text. A document's
fingerprint is the sorted set of the 64-bit hashes of its chains, written in
hex. Likeness is the Jaccard ratio of two sets.

Near-duplicate pairs are found by partitioning on set length: sets of n and m
signatures with Jaccard ratio t or more have t * n <= m, so a set is compared
only within its own and the neighbouring length classes, by its rarest
signatures (the first n - ceil(t * n) + 1 in a global order by frequency).

Edge cases: null and empty texts, and texts without words, have the empty
fingerprint; two empty ones have likeness 1, an empty and another 0; equal texts
have equal fingerprints; of rows with equal doc_id the text's hash decides the
order; a single document is its own next one; texts are read whole; an empty
table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import written

CHAIN = 3

#: Common words of English, German, French and Spanish (own choice, fixed).
COMMON = (
    "a al als an and are as at au auf aus avec be but by ce con da das de del dem den der des die du ein eine el elle en er es est et for from had has have he her his ich il im in is ist it la las "
    "le les lo los mit ne not of on or ou par pas pour pro que qui se sich sie sin son sont su sur te the this that they to un una und une von was were which wie will with y zu zur"
).split()

_NOT_WORD = r"[^\p{L}\p{N}\p{M}|]+"
_NO_ID = -(1 << 63)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted set of the hashes of a text's chains; | stands for an anchor on the way."""
    lined = F.concat(F.lit("|"), F.translate(F.lower(text), "|\n\r", " ||"))
    words = F.split(F.regexp_replace(F.replace(lined, F.lit("|"), F.lit(" | ")), _NOT_WORD, " "), " ")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(COMMON), F.lit("|")).otherwise(w)), " ")
    # an anchor, or several in a row, becomes a mark on the content word after it
    content = F.regexp_replace(marked, r"(?:\| )+", "|")
    chains = F.regexp_extract_all(content, F.lit(rf"\|(?=([^ |]+(?: \|?[^ |]+){{0,{chain - 1}}}))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(F.translate(c, "|", "")))))


def written_form(sigs: Column) -> Column:
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def _next_documents(rows: DataFrame) -> DataFrame:
    """(key, tie) of each distinct document with those of the next one in order; after the last comes the first. No partition holds all."""
    ids = rows.select("key", "tie", "n_chars").distinct()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(ids.repartitionByRange(n, "key", "tie").withColumn("part", F.spark_partition_id()))
    heads = placed.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("head"))  # one row a partition
    first = F.min("head").over(Window.partitionBy())
    after = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), first).alias("after"))
    within = F.lead(F.struct("key", "tie")).over(Window.partitionBy("part").orderBy("key", "tie"))
    joined = placed.withColumn("within", within).join(F.broadcast(after), "part")
    following = F.coalesce("within", "after")
    return written(joined.select("key", "tie", "n_chars", following["key"].alias("next_key"), following["tie"].alias("next_tie")))


def edited(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """For each document its fingerprint, and that of its text with the last quarter replaced by the start of the next document, with likenesses."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = _next_documents(rows.select("key", "tie", F.char_length("text").cast("long").alias("n_chars")))
    # both joins read the same columns of rows, dealt by the same keys, so that texts are shuffled once; signatures are made after that
    again = F.lag(F.lit(True)).over(Window.partitionBy("key", "tie").orderBy("key"))
    one = rows.withColumn("again", again).where("again is null")
    o, b = order.alias("o"), one.alias("b")
    quarter = F.floor(F.col("o.n_chars") / 4).cast("int")
    ahead = o.join(b.hint("shuffle_merge"), (F.col("o.next_key") == F.col("b.key")) & (F.col("o.next_tie") == F.col("b.tie"))).select(
        F.col("o.key").alias("key"), F.col("o.tie").alias("tie"), "n_chars", F.substring(F.col("b.text"), F.lit(1), quarter).alias("more"), signatures(F.col("b.text"), chain).alias("next_sigs"))
    both = rows.join(ahead.hint("shuffle_merge"), ["key", "tie"])
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
    doc_id = F.nullif(F.col("key"), F.lit(_NO_ID)).alias("doc_id")
    new = both.withColumn("new", F.concat(kept, F.col("more"))).select(doc_id, "n_chars", F.sha2("new", 256).alias("edited_sha256"), signatures(F.col("text"), chain).alias("sigs"), "next_sigs", signatures(F.col("new"), chain).alias("new_sigs"))
    return new.select("doc_id", "n_chars", "edited_sha256", written_form(F.col("sigs")).alias("fingerprint"), written_form(F.col("new_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("new_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, least: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of distinct fingerprints with likeness of at least `least`, members (doc_id, fp) of each."""
    text = F.coalesce("text", F.lit(""))
    signed = written(docs.select("doc_id", signatures(text, chain).alias("sigs")).withColumn("fp", F.sha2(F.to_json(F.col("sigs")), 256)))
    sets = written(signed.where(F.size("sigs") > 0).groupBy("fp").agg(F.first("sigs").alias("sigs")))
    many = sets.select("fp", F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("fp", F.size("sigs").alias("n"), F.explode("sigs").alias("s")).join(many, "s")
    nth = F.row_number().over(Window.partitionBy("fp").orderBy("df", "s"))
    prefix = written(ranked.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)))).select("fp", "n", "s", "class"))
    wide = prefix.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    a, b = prefix.alias("a"), wide.alias("b")
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    on = (F.col("a.s") == F.col("b.s")) & (F.col("a.class") == F.col("b.class")) & (low >= high * F.lit(least)) & (F.col("a.fp") != F.col("b.fp"))
    found = a.join(b, on).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()
    sa = sets.select(F.col("fp").alias("a"), F.col("sigs").alias("x"))
    sb = sets.select(F.col("fp").alias("b"), F.col("sigs").alias("y"))
    pairs = found.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, signed.select("doc_id", "fp")
