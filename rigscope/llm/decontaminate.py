"""Operator 9: benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

Texts are sequences of words, their sets those of shingles (``SHINGLE`` words; an item of fewer words is one shingle).
An item's windows are its runs of ``window`` words (a shorter item is one window). A window occurs in a document only
if all its shingles do, in place. So of a window's shingles, ordered by how rare they are in the documents, a prefix
of one is necessary and enough to find every occurrence; the rest is verification.

1. Equal windows, of one item or of many, are one window with several owners. The items' shingles are counted over all
   documents. Each window's rarest one (ties: the hash, then the first place) anchors it; windows next to each other
   mostly share an anchor. Windows whose rarest shingle occurs nowhere go.
2. Documents are cut into stretches of ``STRETCH`` words, each with the words around it that a window may reach. Their
   shingles are joined with the anchors. A match lays the anchor's windows along the document at one offset and takes only
   the words that these cover; length and positional bounds drop windows that would stick out, and the others are compared
   word by word, in the same pass: neither texts nor words are shuffled, and no match carries its document.
3. Occurrences are few and short (window, first word); they alone are grouped by document: into stretches of hit words, by
   ranges of places first, and into the items that own the windows.

The anchors carry the words of their windows. They are measured, in rows and bytes, and broadcast in as many blocks as
keep within bounds, with a pass over the documents for each. The items' shingles and the windows' owners are broadcast
within the same bounds; beyond, their joins are shuffled ones.

Cases: a null text has no words; items without an id or without words are none; repeated items count once; rows
of equal id and text get equal results, each its own, and are grouped once; other columns are ignored; empty tables
give no rows or no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigscope.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Words of a document that are worked off at a time.
STRETCH = 4_096
#: Joined as a shingle, at the place after the last word, this stands for the document itself.
ITSELF = 1 << 40


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def shingles(rows: DataFrame, w: str, sizes: list[int], itself: Column | None = None) -> DataFrame:
    """``rows`` by place: columns at and sh, for every run of each of the sizes in the words of column ``w``.

    Without lambdas, so that words stay in one piece of generated code and are never copied by place. Where ``itself``
    holds, the place after the last word is ITSELF.
    """
    of = lambda n: F.xxhash64(F.lit(n), *(F.get(F.col(w), F.col("at") + i) for i in range(n)))
    inside = [F.when(F.col("at") + n <= F.size(w), of(n)) for n in sizes]
    if itself is not None:
        inside[0] = F.when((F.col("at") == F.size(w)) & itself, F.lit(ITSELF)).otherwise(inside[0])
    placed = rows.select("*", F.posexplode(F.col(w) if itself is None else F.concat(F.col(w), F.array(F.lit("")))).alias("at", "_word")).drop("_word")
    sh = inside[0] if len(inside) == 1 else F.explode(F.array(*inside))
    return placed.select("*", sh.alias("sh")).where(F.col("sh").isNotNull())


def stretches(split: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, base, own, dw): the documents by stretches of words, from the word ``base`` on.

    Places from ``own`` on are the stretch's; before and behind these stand as many words as a window has.
    """
    begin = F.sequence(F.lit(0), F.greatest(F.size("dw") - 1, F.lit(0)), F.lit(STRETCH))
    base = lambda i: F.greatest(i - window, F.lit(0))
    # the lambda ends a piece of generated code, so what one stretch matches is all that is held at a time
    one = F.transform(begin, lambda i: F.struct(base(i).alias("base"), (i - base(i)).alias("own"), F.slice("dw", base(i) + 1, i - base(i) + STRETCH + window).alias("dw")))
    return split.select("doc_id", "text_hash", F.size("dw").cast("long").alias("n_words"), F.explode(one).alias("s")).select("doc_id", "text_hash", "n_words", "s.*")


def blocks(df: DataFrame) -> int:
    """In how many blocks a table can be broadcast, each within bounds of rows and bytes on average."""
    rows, weight = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return max(1, -(-rows // BROADCAST_ROWS), -(-weight // BROADCAST_BYTES))


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, item_id, iw, length, k) of each distinct item with words: its key, words, length of windows and of shingles."""
    w = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words(F.col(f"`{text}`").cast("string")).alias("iw")).where(F.col("item_id").isNotNull() & (F.size("iw") > 0)).distinct()
    length = F.least(F.size("iw"), F.lit(window))
    return w.select(F.conv(F.substring(F.sha2(F.concat_ws(" ", F.base64(F.col("item_id").cast("binary")), F.array_join("iw", " ")), 256), 1, 15), 16, 10).cast("long").alias("item"), "item_id", "iw", length.alias("length"), F.least(length, F.lit(SHINGLE)).alias("k"))


def item_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(item, at, sh) of the items' shingles, each item's of its own size."""
    parts = [shingles(windows.where(F.col("k") == n).select("item", "iw"), "iw", [n]).select("item", "at", "sh") for n in sizes]
    return reduce(DataFrame.unionByName, parts)


def placed_windows(windows: DataFrame) -> DataFrame:
    """(item, item_id, start, wid): every window of every item, by its place and by its words."""
    at = windows.select("item", "item_id", "iw", "length", F.explode(F.sequence(F.lit(0), F.size("iw") - F.col("length"))).alias("start"))
    return at.select("item", "item_id", "start", F.sha2(F.array_join(F.slice("iw", F.col("start") + 1, F.col("length")), " "), 256).alias("wid"))


def anchors(windows: DataFrame, own: DataFrame, counts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(sh, item, length, place, first, starts, context): each anchor's place in its item, and the windows that it anchors,
    of those in ``firsts`` (item, start), whose words are ``context`` from the item's word ``first`` on."""
    known = own.join(counts, "sh", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    span = windows.select("item", (F.col("length") - F.col("k")).alias("more"), (F.size("iw") - F.col("length")).alias("last"))
    # a shingle lies in the windows that start at most ``more`` words before it
    in_windows = known.join(span, "item").select("item", "at", "sh", "n", F.explode(F.sequence(F.greatest(F.col("at") - F.col("more"), F.lit(0)), F.least(F.col("at"), F.col("last")))).alias("start"))
    rarest = in_windows.join(firsts, ["item", "start"]).groupBy("item", "start").agg(F.min(F.struct("n", "sh", "at")).alias("r")).where("r.n > 0")
    kept = rarest.groupBy("item", F.col("r.sh").alias("sh"), F.col("r.at").alias("place")).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    first, last = F.element_at("starts", 1), F.element_at("starts", -1)
    return kept.join(windows, "item").select("sh", "item", "length", "place", first.alias("first"), "starts", F.slice("iw", first + 1, last - first + F.col("length")).alias("context"))


def merged(spans: Column) -> Column:
    """The stretches that sorted spans (first_word, last_word) cover together."""
    none = F.array().cast("array<struct<first_word:int,last_word:int>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("struct<first_word:int,last_word:int>").alias("now"))

    def step(a: Column, s: Column) -> Column:
        longer = F.struct(a["now"]["first_word"].alias("first_word"), F.greatest(a["now"]["last_word"], s["last_word"]).alias("last_word"))
        next_ = F.struct(F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])).alias("done"), s.alias("now"))
        return F.when(s["first_word"] <= a["now"]["last_word"] + 1, F.struct(a["done"].alias("done"), longer.alias("now"))).otherwise(next_)

    return F.aggregate(spans, start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def occurrences(split: DataFrame, sizes: list[int], marks: DataFrame, itself: DataFrame | None, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, item, start, first_word, last_word) of each window found, and with ``itself`` a row without item for each document."""
    places = shingles(stretches(split, window), "dw", sizes, None if itself is None else F.col("base") + F.col("own") == 0)
    mine = (F.col("at") >= F.col("own")) & (F.col("at") < F.col("own") + STRETCH) | (F.col("sh") == ITSELF)
    met = places.where(mine).join(F.broadcast(marks if itself is None else marks.unionByName(itself)), "sh")
    # of the stretch's words only those that the anchor's windows would cover go on; a generator keeps them in one expression
    begin = F.greatest(F.col("at") - F.col("place") + F.col("first"), F.lit(0))
    near = F.explode(F.array(F.struct(begin.alias("begin"), F.slice("dw", begin + 1, F.size("context")).alias("words"), F.size("dw").alias("size"))))
    met = met.select("doc_id", "text_hash", "n_words", "base", "at", "item", "length", "place", "first", "starts", "context", near.alias("near"))
    shift, n = F.col("at") - F.col("place"), F.col("length")
    fits = F.filter(
        "starts",
        lambda s: (shift + s >= 0) & (shift + s + n <= F.col("near.size")) & (F.slice("context", s - F.col("first") + 1, n) == F.slice("near.words", F.greatest(shift + s - F.col("near.begin"), F.lit(0)) + 1, n)),
    )
    out = met.select("doc_id", "text_hash", "n_words", "item", (F.col("base") + shift).alias("from"), "length", F.explode_outer(fits).alias("start"))
    out = out.where(F.col("start").isNotNull() | F.col("item").isNull())
    return out.select("doc_id", "text_hash", "n_words", "item", "start", (F.col("from") + F.col("start")).alias("first_word"), (F.col("from") + F.col("start") + F.col("length") - 1).alias("last_word"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted), spans (stretches of hit words), contaminated, and text_hash, of each row of ``docs``.

    Contaminated: at least ``percent`` of 100 words lie in occurrences of windows, and at least one does.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    windows = written(item_windows(items, window, item_id, item_text), "decontaminate-windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers

    # a generator stands between the words and their uses: put into one expression, they would be split again for each
    split = slim.select("doc_id", "text_hash", F.explode(F.array(words(F.col("text")))).alias("dw"))

    own = item_shingles(windows, sizes)
    vocabulary = written(own.select("sh").distinct(), "decontaminate-shingles")
    said = shingles(split.select("dw"), "dw", sizes).select("sh")
    counts = said.join(F.broadcast(vocabulary) if blocks(vocabulary) == 1 else vocabulary, "sh", "left_semi").groupBy("sh").agg(F.count("*").alias("n"))
    everywhere = placed_windows(windows)
    firsts = everywhere.groupBy("wid").agg(F.min(F.struct("item", "start")).alias("w")).select("wid", "w.item", "w.start")
    firsts = written(firsts, "decontaminate-firsts")
    owners = written(everywhere.select("wid", "item_id").distinct().join(firsts, "wid").select("item", "start", "item_id"), "decontaminate-owners")
    marks = written(anchors(windows, own, counts, firsts.select("item", "start")), "decontaminate-anchors")
    itself = docs.sparkSession.range(1).select(*((F.lit(ITSELF) if n == "sh" else F.lit(None)).cast(t).alias(n) for n, t in marks.dtypes))
    n = blocks(marks)
    block = F.pmod(F.xxhash64("sh", "item", "place"), F.lit(n))  # one shingle may anchor very many windows
    found = reduce(DataFrame.unionByName, (written(occurrences(split, sizes, marks.where(block == b), None if b else itself, window), "decontaminate-found") for b in range(n)))
    every = found.where(F.col("item").isNull()).select("doc_id", "text_hash", "n_words")
    one = found.where(F.col("item").isNotNull())
    key = ["doc_id", "text_hash"]
    span = F.struct("first_word", "last_word").alias("span")
    pieces = one.select(*key, (F.col("first_word") / STRETCH).cast("int").alias("part"), span).groupBy(*key, "part").agg(merged(F.array_sort(F.collect_set("span"))).alias("spans"))
    spans = pieces.select(*key, F.explode("spans").alias("span")).groupBy(*key).agg(merged(F.array_sort(F.collect_list("span"))).alias("spans"))
    named = F.broadcast(owners) if blocks(owners) == 1 else owners
    items = one.select(*key, "item", "start").distinct().join(named, ["item", "start"]).groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    items = items.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("j"), "item_ids")
    hits = spans.join(items, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("j")))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last_word"] - s["first_word"] + 1)
    hits = hits.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"), length.alias("n_hit"), "item_ids", "spans")
    out = every.join(hits, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<first_word:int,last_word:int>>")).alias("spans"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )
