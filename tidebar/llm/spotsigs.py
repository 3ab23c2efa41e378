"""Document fingerprints from spot signatures: DataFrame functions only.

A spot is a common word that a content word follows; its signature is the common word and the chain of the next two content words (common words between these
are skipped). A fingerprint is the sorted set of its text's signatures, each as 8 hex digits.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted

# Common words of English, German, French and Spanish.
COMMON = (
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its more most no not of on one only or other our out over she so some "
    "such than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im ist kann man mich mit nach nicht noch nur oder sein sich sie sind über um und uns vom von vor war wenn wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais me ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tu un une vous y "
    "al como con cuando del donde el ella ellos era esta este fue ha hay las lo los mi muy nos para pero por porque sin sobre su sus te tiene todo una unos yo"
).split()
WORDS = sorted(set(COMMON))
#: Ids that share a bucket while the next document is looked up, at least, and buckets at most: sparse ids get wider ones.
RUN, RUNS = 1024, 1 << 16


def bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures; where it has no spot, one signature of all its words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    short = lambda x: F.substring(F.md5(x), 1, 8)

    def chains(t: Column) -> Column:
        content = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~F.element_at(t, i).isin(WORDS))

        def spots(c: Column) -> Column:
            at = lambda k: F.element_at(c, k)
            spot = lambda k: F.when(k == 1, at(k) > 1).otherwise(at(F.greatest(k - 1, F.lit(1))) < at(k) - 1)
            ks = F.filter(F.sequence(F.lit(1), F.size(c) - 1), spot)
            return F.transform(ks, lambda k: short(F.concat_ws(" ", F.element_at(t, at(k) - 1), F.element_at(t, at(k)), F.element_at(t, at(k + 1)))))

        found = F.when(F.size(content) >= 2, bind(content, spots)).otherwise(F.array().cast("array<string>"))
        whole = F.array(short(F.concat(F.lit("all "), F.array_join(t, " "))))
        return bind(found, lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(whole))

    # sequence(1, 0) would count down, so texts without words take the other way.
    return bind(words, lambda t: F.when(F.size(t) > 0, chains(t)).otherwise(F.array(short(F.lit("all ")))))


def fingerprint(text: Column) -> Column:
    return F.array_join(signatures(text), " ")


def likeness(left: Column, right: Column, least: float = 0.0) -> Column:
    """Jaccard of two fingerprints; pairs whose set lengths alone keep it below `least` are 0 without being compared."""
    pair = F.struct(F.split(left, " ").alias("x"), F.split(right, " ").alias("y"))

    def jaccard(p: Column) -> Column:
        n, m = F.size(p["x"]), F.size(p["y"])
        both = bind(F.size(F.array_intersect(p["x"], p["y"])).cast("double"), lambda b: b / (n + m - b))
        return F.when(F.least(n, m) < least * F.greatest(n, m), F.lit(0.0)).otherwise(both)

    return F.when(left == right, F.lit(1.0)).otherwise(bind(pair, jaccard))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row for each row of docs. Null texts are empty; equal texts have equal fingerprints."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fingerprint"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """(a, b, likeness): the pairs of different fingerprints with Jaccard of at least `least`, each named by its least id.

    Sets are dealt by length, so that only lengths in the ratio that `least` allows meet, and within a length class by
    the first signatures in hash order, of which a pair must share one; what meets is compared if the lengths allow it. Rows without an id are left out.
    """
    sets = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fingerprint"))
    sets = cut(sets.groupBy("fingerprint").agg(F.min("id").alias("id")).withColumn("n", F.size(F.split("fingerprint", " "))))
    share = F.col("n") - F.ceil(F.col("n") * least) + 1
    keyed = sets.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / log(1 / least))).withColumn("key", F.explode(F.slice(F.split("fingerprint", " "), F.lit(1), share.cast("int"))))
    left = keyed.select("key", "class", F.col("id").alias("a"), F.col("n").alias("n"))
    right = keyed.select("key", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = left.join(right, ["key", "class"]).where("a < b").where(F.least("n", "m") >= least * F.greatest("n", "m")).select("a", "b").distinct()
    named = lambda i, f: sets.select(F.col("id").alias(i), F.col("fingerprint").alias(f))
    return pairs.join(named("a", "x"), "a").join(named("b", "y"), "b").select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).where(F.col("likeness") >= least)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    A text's edited version has its last floor(n_chars / 2) code points replaced by the first as many of the next document by id (after the last:
    the first; rows that repeat an id are in order of text). Null texts are empty. Rows without an id have no next document: their edited
    text is cut short and near_next is null. Ids are looked up in runs, RUNS at most; a run's rows are sorted and walked in order, and only its first id is put in order with those of the others.
    An empty table gives none; other columns don't matter.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with_id = base.where("doc_id is not null")
    low, high = with_id.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(RUN, -(-((high or 0) - (low or 0) + 1) // RUNS))
    # Whole numbers only: doubles can't tell large ids apart.
    with_id = with_id.withColumn("run", F.expr(f"doc_id div {width}L"))
    heads = with_id.groupBy("run").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("run")
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nexts = cut(heads.select("run", F.coalesce(F.lead("head").over(order), first).alias("head")))
    mine = with_id.select("doc_id", "text").join(_hinted(nexts, "doc_id"), "doc_id")
    bridge = mine.groupBy("run").agg(F.min("text").alias("text")).select("run", F.struct("text", fingerprint(F.col("text")).alias("fingerprint")).alias("bridge"))
    marked = with_id.withColumn("fingerprint", fingerprint(F.col("text")))
    step = F.lead(F.struct("text", "fingerprint")).over(Window.partitionBy("run").orderBy("doc_id", "text"))
    chained = marked.withColumn("step", step).join(bridge, "run", "left").withColumn("step", F.coalesce("step", "bridge"))
    last = base.where("doc_id is null").withColumn("fingerprint", fingerprint(F.col("text")))
    none = F.lit(None).cast("struct<text:string,fingerprint:string>")
    both = chained.select("doc_id", "text", "fingerprint", "step").unionByName(last.select("doc_id", "text", "fingerprint", none.alias("step")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half)), F.coalesce(F.substring(F.col("step.text"), F.lit(1), half), F.lit("")))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("step.fingerprint").alias("next"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next").alias("near_next"))


def _hinted(frame: DataFrame, name: str) -> DataFrame:
    """hinted(), with the column head renamed."""
    out = frame.withColumnRenamed("head", name)
    out.written_to = frame.written_to
    return hinted(out)
