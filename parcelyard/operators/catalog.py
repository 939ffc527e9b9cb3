"""File catalogs and participant tables: names to columns, top matches, selection, availability."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The entities of file names and what follows them, and the names that stand for a metabolite.
TAGS = {"subject": "sub-([^_]+)", "session": "ses-([^_]+)", "run": "run-([^_]+)", "acq": "acq-([^_]+)", "space": "space-([^_]+)", "atlas": "atlas-(?:chimera)?([^_]+)", "scale": "scale([0-9]+)", "grow": "grow([0-9]+)mm", "npert": "npert[-_]([0-9]+)", "filt": "filt([^_]+)", "met": "met-([^_]+)", "res": "res-([^_]+)", "desc": "desc-([^_.]+)", "suffix": "_([A-Za-z0-9]+)[.]"}
NUMBERS = {"scale", "grow", "npert"}
SYNONYMS = {"Glx": "GluGln", "tNAA": "NAANAAG", "tCr": "CrPCr", "Cho": "GPCPCh"}


def tag(name: Column, which: str) -> Column:
    """One entity of a file's name, whatever its folders hold; null if it isn't there."""
    name = F.element_at(F.split(name, "/"), -1)
    found = F.nullif(F.regexp_extract(name, TAGS[which], 1), F.lit(""))
    return found.try_cast("int") if which in NUMBERS else found


def with_tags(files: DataFrame, name: str, wanted: list[str] | None = None) -> DataFrame:
    return files.withColumns({t: tag(F.col(name), t) for t in wanted or TAGS})


def session_token(c: Column) -> Column:
    """T<n> and t<n> as V<n>."""
    return F.regexp_replace(F.upper(c), "^T([0-9]+)", "V$1")


def metabolite(c: Column) -> Column:
    """The usual name of a metabolite."""
    names = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.coalesce(F.element_at(names, c), c)


def canonical_path(subject: Column, session: Column, space: Column, met: Column, desc: Column) -> Column:
    folder = F.concat_ws("/", F.concat(F.lit("sub-"), subject), F.concat(F.lit("ses-"), session), F.lit("mrsi"))
    file = F.concat_ws("_", F.concat(F.lit("sub-"), subject), F.concat(F.lit("ses-"), session), F.concat(F.lit("space-"), space), F.concat(F.lit("met-"), met), F.concat(F.lit("desc-"), desc))
    return F.concat(folder, F.lit("/"), file, F.lit("_mrsi.nii.gz"))


def suffix_of(names: Column) -> Column:
    """Metabolite names in lower case without other characters, joined by underscores; empty ones go."""
    clean = F.transform(names, lambda m: F.regexp_replace(F.lower(m), "[^a-z0-9]+", ""))
    return F.array_join(F.filter(clean, lambda m: m != ""), "_")


def resolution(zooms: Column) -> Column:
    """Mean zoom as text: tenths, padded, below 1 mm; else rounded half to even."""
    mean = F.aggregate(zooms, F.lit(0.0), lambda a, x: a + x) / F.size(zooms)
    return F.when(mean < 1, F.lpad(F.bround(mean * 10).cast("int").cast("string"), 2, "0")).otherwise(F.bround(mean).cast("int").cast("string"))


def best_match(files: DataFrame, recording: list[str], name: str, terms: list[Column]) -> DataFrame:
    """Of each recording's files the one that fits most terms (then the first name, letter case aside); none if nothing fits."""
    score = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in terms), F.lit(0))
    order = Window.partitionBy(*recording).orderBy(F.desc("score"), F.lower(name), name)
    return files.withColumn("score", score).withColumn("_n", F.row_number().over(order)).where("_n = 1 and score > 0").drop("_n")


def pairs(rows: DataFrame, subject: str, session: str, order: str) -> DataFrame:
    """Distinct (subject, session) in order of first appearance; blanks trimmed, empty ones dropped."""
    clean = rows.select(F.trim(subject).alias("subject"), F.trim(session).alias("session"), order).where("subject <> '' and session <> ''")
    return clean.groupBy("subject", "session").agg(F.min(order).alias("ord"))


def aliased(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their own names, found by any of their aliases (letter case and punctuation aside)."""
    norm = lambda c: re.sub(r"[^a-z0-9]", "", c.lower())
    by_norm = {norm(c): c for c in df.columns}
    chosen = {}
    for name, others in aliases.items():
        hit = next((by_norm[norm(a)] for a in [name, *others] if norm(a) in by_norm), None)
        if hit is None:
            raise ValueError(f"no column for {name!r} among {df.columns}")
        chosen[name] = hit
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in chosen.items()))


def classified(files: DataFrame, name: str) -> DataFrame:
    """kind: the first of cat12, mrsi, t1 whose tokens a name has; other kinds are null. mrsi files also get met and desc."""
    n = F.lower(name)
    cat12 = n.rlike("^(m?w?p[0-3]|wm|iy_|y_)[a-z0-9_]*") & n.rlike("[.]nii([.]gz)?$") & ~n.contains("mrsi")
    mrsi = n.rlike("(_conc_|_crlb_|_snr|_fwhm|mrsi)")
    t1 = n.rlike("(t1w|mprage|mp2rage|memprage)") & ~n.rlike("(mask|seg|dseg)")
    kind = F.when(cat12, "cat12").when(mrsi, "mrsi").when(t1, "t1")
    found = F.regexp_extract(F.col(name), r"(?i)_([A-Za-z0-9+]+)_(conc|crlb)_", 1)
    desc = F.regexp_extract(F.col(name), r"(?i)_[A-Za-z0-9+]+_(conc|crlb)_", 1)
    return files.withColumn("kind", kind).withColumn("met", F.when(kind == "mrsi", F.nullif(F.replace(found, F.lit("+"), F.lit("")), F.lit("")))).withColumn("desc", F.when(kind == "mrsi", F.when(F.lower(desc) == "conc", "signal").otherwise(F.nullif(F.lower(desc), F.lit("")))))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def availability(requirements: DataFrame, recording: list[str], item: str, found: str) -> DataFrame:
    """(recording, found, expected, missing): counts, and the missing items in order, joined by commas."""
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col(found), F.col(item)))), ",")
    return requirements.groupBy(*recording).agg(F.count_if(F.col(found)).alias("found"), F.count("*").alias("expected"), missing.alias("missing"))


def migration_plan(files: DataFrame, source: str, target: str, existing: DataFrame | None = None) -> DataFrame:
    """(source, target, action): convert, copy, or skip what is already there. No bytes are moved."""
    plan = files.select(F.col(source).alias("source"), F.col(target).alias("target"))
    there = (existing.select(F.col("path").alias("target")).distinct() if existing is not None else plan.select("target").where("false")).withColumn("_there", F.lit(True))
    convert = F.col("source").endswith(".nii") & F.col("target").endswith(".nii.gz")
    return plan.join(there, "target", "left").select("source", "target", F.when(F.col("_there"), "skip").when(convert, "convert").otherwise("copy").alias("action"))


OPERATORS = (">=", "<=", "!=", ">", "<", "==")


def numeric_columns(table: DataFrame) -> set[str]:
    """Columns of numbers, and those all of whose values (blanks aside) read as numbers; one pass over the table."""
    native = {f.name for f in table.schema if f.dataType.simpleString() in ("int", "bigint", "double", "float", "smallint", "tinyint") or f.dataType.simpleString().startswith("decimal")}
    others = [f.name for f in table.schema if f.name not in native and f.dataType.simpleString() == "string"]
    if not others:
        return native
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = table.agg(*(F.count_if(filled(c).isNotNull() & filled(c).try_cast("double").isNull()).alias(f"bad{k}") for k, c in enumerate(others)), *(F.count(filled(c)).alias(f"n{k}") for k, c in enumerate(others))).first()
    return native | {c for k, c in enumerate(others) if found[f"bad{k}"] == 0 and found[f"n{k}"] > 0}


def selections(terms: list[str], columns: list[str]) -> list[tuple[str, str, str]]:
    """(column, operator, value) of each ``NAME,[op]VALUE``; names as they are, else letter case aside; == where no operator stands."""
    out = []
    for term in terms:
        name, comma, rest = term.partition(",")
        name, rest = name.strip(), rest.strip()
        found = name if name in columns else next((c for c in columns if c.lower() == name.lower()), None)
        if not comma or found is None:
            raise ValueError(f"cannot read the selection {term!r}")
        op = next((o for o in OPERATORS if rest.startswith(o)), None)
        out.append((found, op or "==", rest[len(op) :].strip() if op else rest))
    return out


def predicate(terms: list[str], columns: list[str], numeric: set[str], strict: bool = False) -> Column:
    """The participant language. Several == on one column are alternatives (all must hold if ``strict``); everything else must hold.

    Numeric columns compare numbers, others text. A missing value holds for != and fails otherwise.
    """
    parsed = selections(terms, columns)
    whole: Column = F.lit(True)
    equal: dict[str, list[str]] = {}
    for name, op, value in parsed:
        if op == "==" and not strict:
            equal.setdefault(name, []).append(value)
            continue
        whole = whole & _compared(name, op, value, name in numeric)
    for name, values in equal.items():
        any_of: Column = F.lit(False)
        for value in values:
            any_of = any_of | _compared(name, "==", value, name in numeric)
        whole = whole & any_of
    return whole


def _compared(name: str, op: str, value: str, numeric: bool) -> Column:
    c = F.trim(F.col(name).cast("string"))
    right: Column = F.lit(value)
    if numeric:
        c, right = c.try_cast("double"), F.lit(float(value))
    elif op not in ("==", "!="):
        raise ValueError(f"{name!r} holds text, which {op!r} cannot compare")
    test = {"==": c == right, "!=": c != right, ">": c > right, "<": c < right, ">=": c >= right, "<=": c <= right}[op]
    return F.coalesce(test, F.lit(op == "!="))


def selection_suffix(terms: list[str], columns: list[str], strict: bool = False) -> str:
    """A name for the selection: sel-<col>-in<a>_<b> for alternatives, -<op in letters><value> for the rest. ``strict``: <col>-<op><value> of each term, signs as they are."""
    if strict:
        return "_".join(f"{name}-{op}{value}" for name, op, value in selections(terms, columns))
    words = {">=": "ge", "<=": "le", "!=": "ne", ">": "gt", "<": "lt"}
    parts: dict[str, list[str]] = {}
    equal: dict[str, list[str]] = {}
    for name, op, value in selections(terms, columns):
        if op == "==":
            equal.setdefault(name, []).append(value)
            parts.setdefault(name, [])
        else:
            parts.setdefault(name, []).append(words[op] + value)
    return "_".join("sel-" * (k == 0) + "-".join([name, *(["in" + "_".join(equal[name])] if name in equal else []), *rest]) for k, (name, rest) in enumerate(parts.items()))


def pair_mask(table: DataFrame, chosen: DataFrame, keys: list[str], out: str = "selected") -> DataFrame:
    """``table`` with whether its pair is among ``chosen``."""
    marked = chosen.select(*keys).distinct().withColumn(out, F.lit(True))
    return table.join(marked, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def text_search(c: Column, needle: str) -> Column:
    """``re:`` in front means a regular expression (one that can't be read matches all); else a part of the text, letter case aside."""
    if needle.startswith("re:"):
        try:
            re.compile(needle[3:])
        except re.error:
            return F.lit(True)
        return c.rlike("(?i)" + needle[3:])
    return F.contains(F.lower(c), F.lit(needle.lower()))


def without_terms(c: Column, terms: list[str]) -> Column:
    """True where none of the terms is a part of the text."""
    return ~F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(c, t)) if terms else F.lit(True)


def super_region(c: Column) -> Column:
    first = F.substring(c, 1, 9)
    return F.replace(F.replace(first, F.lit("-lh"), F.lit("")), F.lit("-rh"), F.lit(""))
