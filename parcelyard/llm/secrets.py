"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Base kinds, leftmost and non-overlapping each: ``assign`` (a keyword, a sign, a value of 8 and more characters), ``access`` (AKIA...,
16 and more) and ``hex`` (32 and more digits). A pattern parts a text into matches and what lies between, so places follow from lengths.

Every candidate's value is hashed, and the corpus counts the distinct repositories and owners that hold it. A value that more than
``max_owners`` owners hold is a copied example; one that few hold is live-looking. The scan then adds ``owned`` spans: bare tokens with
digits, outside the base spans, whose value is live-looking and either stands behind a keyword elsewhere or mixes capital and small letters
and digits over 24 characters and more. Base spans stay whatever their frequency; each span says whether it is live-looking.

Repository: the source column; owner: what stands before its first slash (all of it if there is none).

Defined results: null and empty texts have no spans; a null source is one owner; rows with one doc_id, or none, are scanned apart; other
columns stay, and added names get underscores in front if they clash. Equal spans of different kinds all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

# Patterns and least lengths of the base kinds, in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*[0-9][A-Za-z0-9+/_=-]*"
LEAST = {"assign": 8, "access": 16, "hex": 32, "owned": 8}
BARE_ALONE = 24
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]


def parts(text: Column, pattern: str, kind: str, value_group: int = 0, where: Column | None = None) -> Column:
    """Array of (kind, gap, width, value) of the pattern's matches in order: characters between the match before and this one, the match's own, and its value. Time is linear in the text."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    listed = F.transform(
        F.arrays_zip(between.alias("b"), matches.alias("m"), values.alias("v")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("width"), x["v"].alias("value")),
    )
    holds = text.rlike(pattern) if where is None else where & text.rlike(pattern)
    return F.when(F.coalesce(holds, F.lit(False)), listed).otherwise(F.array().cast("array<struct<kind:string,gap:int,width:int,value:string>>"))


def candidates(text: Column) -> Column:
    """Parts of the base kinds, and of bare tokens with a digit, of one text."""
    lower = F.lower(text)
    named = None
    for word in KEYWORDS:
        named = lower.contains(word) if named is None else named | lower.contains(word)
    return F.concat(
        parts(text, ASSIGN, "assign", 2, named),
        parts(text, ACCESS, "access", where=text.contains("AKIA")),
        parts(text, HEX, "hex"),
        parts(text, BARE, "owned", where=text.rlike("[0-9]")),
    )


def found_spans(documents: DataFrame, max_owners: int = 3, text: str = "text", source: str = "source", keep_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The rows, numbered and written, without the text if it isn't kept: those with candidates, and the others, which need no shuffle; the spans (row, kind, order, start, end, live, repositories, owners), one row a span; and the number's name.

    Candidates are few against the text, so they alone are shuffled: by row for their places (running sums of gaps and widths), by value
    hash for the counts (summed before the shuffle, so a value that a third of all documents hold is one row a task).
    """
    row, found = (free_name(documents, n) for n in ("scan_row", "scan_found"))
    owner = F.coalesce(F.col(source), F.lit("")) if source in documents.columns else F.lit("")
    numbered = documents.withColumn(row, F.monotonically_increasing_id()).withColumn(found, candidates(F.col(text)))
    numbered = cut(numbered if keep_text else numbered.drop(text))
    listed = numbered.select(F.col(row).alias("row"), owner.alias("repository"), F.posexplode(found).alias("n", "c")).select("row", "repository", "n", "c.*")
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = listed.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("width"))
    order = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(KINDS)))
    long_enough = F.length("value") >= F.element_at(F.create_map(*(x for k, n in LEAST.items() for x in (F.lit(k), F.lit(n)))), F.col("kind"))
    placed = placed.where(long_enough).select("row", F.split("repository", "/", 2)[0].alias("owner"), "repository", "kind", order.alias("order"), "start", "end", "value", F.sha2("value", 256).alias("hash"))
    held = placed.groupBy("hash", "repository", "owner").agg(F.max(F.col("kind") != "owned").alias("named")).groupBy("hash").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"), F.max("named").alias("named"))
    # A bare token that meets a base span of its row is that span's own: one that began before and ends later, or that begins before its end.
    base = F.col("kind") != "owned"
    in_order = Window.partitionBy("row").orderBy("start", "order")
    before = F.coalesce(F.max(F.when(base, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("order")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.min(F.when(base, F.col("start"))).over(backwards)  # a frame up to the end would be gone through again for every row
    own = placed.withColumn("meets", (before > F.col("start")) | F.coalesce(after < F.col("end"), F.lit(False))).where(base | ~F.col("meets"))
    value = F.col("value")
    mixed = (F.length(value) >= BARE_ALONE) & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")
    live = F.col("owners") <= max_owners
    kept = own.join(held, "hash").where(base | (live & (F.col("named") | mixed)))
    kept = kept.select(F.col("row").alias(row), "kind", "order", "start", "end", live.alias("live"), "repositories", "owners")
    return numbered.where(F.size(found) > 0).drop(found), numbered.where(F.size(found) == 0).drop(found), kept, row


def scan(documents: DataFrame, max_owners: int = 3, text: str = "text", source: str = "source", result: str = "secrets", keep_text: bool = True) -> DataFrame:
    """``documents`` (without the text if it isn't kept) with ``result``: array of (start, end, kind, live, ...), by start, then kind as listed."""
    name = free_name(documents, result)
    some, others, kept, row = found_spans(documents, max_owners, text, source, keep_text)
    spans = kept.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind", "live", "repositories", "owners"))).alias(name))
    plain = F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["live"].alias("live"), s["repositories"].alias("repositories"), s["owners"].alias("owners")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean,repositories:bigint,owners:bigint>>")
    columns = [c for c in documents.columns if keep_text or c != text]
    some = some.join(spans, row, "left").withColumn(name, F.coalesce(plain, empty))
    return some.select(*columns, name).unionByName(others.withColumn(name, empty).select(*columns, name))


def listed(spans: Column, kinds: list[str] = KINDS) -> Column:
    """kind:start:end of each span, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(documents: DataFrame, text: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """``documents`` whose live-looking spans are replaced by ``mask``, spans that overlap by one; copied examples stay.

    The text is cut as UTF-32, where a place is found without counting characters, so time is linear in text and spans. Only rows with
    candidates are shuffled.
    """
    some, others, kept, row = found_spans(documents, text=text, **options)
    in_order = Window.partitionBy(row).orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    live = kept.where("live").withColumn("from", F.coalesce(F.max("end").over(in_order), F.lit(0)))
    pieces = live.groupBy(row).agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", "start")))).alias("p"), F.max("end").alias("e"))
    cuts = free_name(documents, "scan_cuts")
    pieces = pieces.select(row, F.struct("p", "e").alias(cuts))
    # The text is an array's one element, so that it is encoded once a row and not once a piece.
    whole = F.array(F.struct(F.encode(F.col(text), "UTF-32").alias("t"), F.col(f"{cuts}.p").alias("p"), F.col(f"{cuts}.e").alias("e")))
    piece = lambda t, a, b: F.decode(F.substring(t, 4 * a + 1, 4 * (b - a)), "UTF-32")
    rebuilt = F.transform(whole, lambda x: F.concat(F.array_join(F.transform(x["p"], lambda c: F.concat(piece(x["t"], c["from"], c["start"]), F.lit(mask))), ""), piece(x["t"], x["e"], F.length(x["t"]))))
    changed = some.join(pieces, row, "left").withColumn(text, F.when(F.col(cuts).isNotNull(), F.element_at(rebuilt, 1)).otherwise(F.col(text)))
    return changed.select(*documents.columns).unionByName(others.select(*documents.columns))
