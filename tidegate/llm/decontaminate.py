"""Benchmark decontamination with DataFrame functions only: a hash set of normalised benchmark windows, verified hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.staging import Stage

WINDOW = 13
#: A document is contaminated if hit words make up this share of its words.
SHARE = (1, 20)
#: Windows of all items and entries of their lists of items that a broadcast may hold, about 300 bytes each; more are
#: joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: First words of a window that are looked up before all its words are compared.
HEAD = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters; A-Z in lower case. A null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    # cutting at separators takes an eighth of the time that listing the matches of a word's pattern takes
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _windows(words: Column, lengths: list[int], head: int | None) -> Column:
    """(len, pos, hash) of all windows of the given lengths, by their `head` first words or all; with a head also one
    of length 0, which every document has."""
    marker = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("hash")))
    first = F.array().cast("array<struct<len:int,pos:int,hash:bigint>>") if head is None else marker
    return F.concat(first, *[_windows_of(words, n, head) for n in lengths])


def _windows_of(words: Column, n: int, head: int | None) -> Column:
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))

    def hashed(i: Column) -> Column:
        if head is None:
            return F.xxhash64(F.slice(words, i + 1, n))
        return F.xxhash64(*[F.get(words, i + k) for k in range(min(n, head))])

    return F.transform(places, lambda i: F.struct(F.lit(n).alias("len"), i.alias("pos"), hashed(i).alias("hash")))


def _window_hash(gram: Column, head: int | None) -> Column:
    if head is None:
        return F.xxhash64(gram)
    cases = F.xxhash64(*[F.get(gram, F.lit(k)) for k in range(head)])
    for n in range(1, head):
        cases = F.when(F.size(gram) == n, F.xxhash64(*[F.get(gram, F.lit(k)) for k in range(n)])).otherwise(cases)
    return cases


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Different windows of all items (len, gram, items); an item of fewer words is one window."""
    words = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    size = F.size("words")
    length = F.least(size, F.lit(window))
    placed = words.filter(size > 0).select(
        "item", length.alias("len"), F.explode(F.transform(
            F.sequence(F.lit(1), size - length + 1), lambda i: F.slice("words", i, length))).alias("gram"))
    return placed.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: tuple[int, int] = SHARE,
                  broadcast_windows: int = BROADCAST_WINDOWS, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Windows of benchmark items in every document.

    Returns a row per document: doc_id, text_key (hash of its text), n_words, n_hit (words inside any occurrence of a
    window), items (ids of the items with occurring windows), spans (disjoint ranges of hit words, start and stop from
    0), contaminated (n_hit > 0 and n_hit / n_words >= share). Null or empty texts have no words and no hits, equal
    rows each give their row, an empty benchmark gives no hits, an item without id marks words but is not listed.

    Up to `broadcast_windows` different windows go to every task; a document's windows then never leave theirs. With
    more, windows are joined by hash over a shuffle and hits are verified against the texts afterwards.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                        words_of(F.col(text_col)).alias("words"))
    grams = Stage(benchmark_windows(benchmark, window, item_col, item_text_col), "windows").read()
    per_length = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.sum(1 + F.size("items")).alias("n")).collect()}
    small = sum(per_length.values()) <= broadcast_windows
    head = HEAD if small else None
    grams = grams.withColumn("hash", _window_hash(F.col("gram"), head))
    spread = keyed.select("doc_id", "text_key", "words", F.size("words").cast("long").alias("n_words"),
                          F.explode(_windows(F.col("words"), sorted(per_length), head)).alias("w"))
    key = ["doc_id", "text_key", "n_words"]
    # a row of length 0 for each document, so that those without hits come out too
    none = F.array().cast(grams.schema["items"].dataType).alias("items")
    if small:
        every = docs.sparkSession.range(1).select(
            F.lit(0).alias("len"), F.array().cast("array<string>").alias("gram"), none, F.lit(0).cast("long").alias("hash"))
        wanted = F.broadcast(grams.unionByName(every).select(F.col("hash").alias("g_hash"), "gram", "items"))
        # as two comparisons: an equality would be a join key, and all words of every window be hashed for it
        gram = F.slice("words", F.col("w.pos") + 1, F.col("w.len"))
        same = (F.col("w.hash") == F.col("g_hash")) & (gram >= F.col("gram")) & (gram <= F.col("gram"))
        hits = spread.join(wanted, same).select(*key, "w.pos", "w.len", "items")
    else:
        found = spread.select(*key, "w.*").join(grams, ["len", "hash"])
        texts = keyed.dropDuplicates(["doc_id", "text_key"]).select(
            F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key"), "words")
        hits = found.join(
            texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key"))
        ).filter(F.slice("words", F.col("pos") + 1, F.col("len")) == F.col("gram")).select(*key, "pos", "len", "items")
        hits = hits.unionByName(keyed.select(
            "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.lit(0).alias("pos"), F.lit(0).alias("len"), none))
    place = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"))
    grouped = hits.groupBy(*key).agg(
        F.count(F.when(F.col("len") == 0, 1)).cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("len") > 0, place))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
        lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["stop"] - F.greatest(p["start"], a["until"]))).alias("n"),
                              F.greatest(a["until"], p["stop"]).alias("until")))
    n_hit = covered["n"].cast("long")
    part, whole = share
    return (
        grouped.select(*key, "items", "copies", "places", n_hit.alias("n_hit"))
        .select("doc_id", "text_key", "n_words", "n_hit", "items", _merged(F.col("places")).alias("spans"),
                ((F.col("n_hit") > 0) & (F.col("n_hit") * whole >= F.col("n_words") * part)).alias("contaminated"),
                F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .drop("copy")
    )


def _merged(places: Column) -> Column:
    """Sorted ranges with those that meet joined; only a closed range is added to the list."""
    kind = "array<struct<start:int,stop:int>>"
    one = lambda a: F.when(a["stop"] >= 0, F.array(F.struct(a["start"].alias("start"), a["stop"].alias("stop")))).otherwise(
        F.array().cast(kind))
    none = F.struct(F.array().cast(kind).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    meet = lambda a, p: F.when(a["stop"] >= p["start"], F.struct(
        a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["stop"], p["stop"]).alias("stop"))).otherwise(
        F.struct(F.concat(a["done"], one(a)).alias("done"), p["start"].alias("start"), p["stop"].alias("stop")))
    return F.aggregate(places, none, meet, lambda a: F.concat(a["done"], one(a)))


def _found_rows(docs: DataFrame, found: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of `docs` as a struct `row`, joined to (found_id, found_key, ...): no column can meet one of another name."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    return row.join(found, F.col(f"row.{id_col}").eqNullSafe(F.col("found_id")) & (
        F.xxhash64(f"row.{text_col}") == F.col("found_key")), how)


def remove_documents(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `contamination` does not call contaminated, with all their columns, whatever their names.

    Null ids and texts match their own rows; equal rows stay or go together; empty tables give empty ones.
    """
    bad = found.filter("contaminated").select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"))
    return _found_rows(docs, bad, "left_anti", id_col, text_col).select("row.*")


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents without the words hit and what stands before each of them; columns as in `docs`.

    A null text stays null; equal rows are cut alike.
    """
    hit = found.filter("n_hit > 0").select(
        F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "spans"
    ).dropDuplicates(["found_id", "found_key"])
    body = F.col(f"row.{text_col}")
    pieces = F.regexp_extract_all(body, F.lit(f"{SEPARATOR_ANY_CASE}*{WORD_ANY_CASE}"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["stop"])))
    tail = F.regexp_extract(body, f"({SEPARATOR_ANY_CASE}*)$", 1)
    text = F.when(F.col("spans").isNull(), body).otherwise(F.concat(F.array_join(kept, ""), tail))
    joined = _found_rows(docs, hit, "left", id_col, text_col)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
