"""Document numbers: one canonical key for every spelling of number, year, kind and issuer code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vankho.functions.marks import fold, fold_text

#: Document kinds, folded name and short form.
KINDS = [("quyet dinh", "qd"), ("nghi quyet", "nq"), ("thong tu", "tt"), ("chi thi", "ct")]
#: The issuer list is a fixed small table; more bodies than this and it must not become literals.
MAX_BODIES = 5000


@dataclass(frozen=True)
class Issuers:
    """Issuer codes and the folded names that stand for a code (province left out)."""

    codes: tuple[str, ...]
    names: tuple[tuple[str, str], ...]


def issuers(bodies: DataFrame) -> Issuers:
    """Codes and names from issuing_bodies; raises when that table is larger than the stated bound."""
    rows = bodies.select("ten_chinh_thuc", "ma_hieu", "ten_thuong_goi", "tinh").limit(MAX_BODIES + 1).collect()
    if len(rows) > MAX_BODIES:
        raise ValueError(f"more than {MAX_BODIES} issuing bodies")
    codes, names = set(), set()
    for r in rows:
        if not r.ma_hieu:
            continue
        code = fold_text(r.ma_hieu)
        codes.add(code)
        name = fold_text(r.ten_chinh_thuc or "")
        if r.tinh:
            name = name.replace("tinh " + fold_text(r.tinh), "")
        names.update((n.strip(), code) for n in (name, fold_text(r.ten_thuong_goi or "")) if n.strip())
    return Issuers(tuple(sorted(codes)), tuple(sorted(names)))


_SPLIT = "(?<![a-z])(?:qd|nq|tt|ct)(?![a-z])"


def _sorted_letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def _scored(typed: Column, options: list[tuple[str, str]]) -> Column:
    """array<struct<d, v>>: the edit distance of `typed` to every option; swapped neighbours count as one edit."""
    table = F.array(*[F.struct(F.lit(text).alias("t"), F.lit("".join(sorted(text))).alias("s"), F.lit(value).alias("v")) for text, value in options])
    distance = lambda o: F.when((F.length(o["t"]) == F.length(typed)) & (o["s"] == _sorted_letters(typed)), F.when(o["t"] == typed, 0).otherwise(1)).otherwise(
        F.levenshtein(o["t"], typed)
    )
    return F.transform(table, lambda o: F.struct(distance(o).alias("d"), o["v"].alias("v")))


def with_number_parts(df: DataFrame, column: str, known: Issuers) -> DataFrame:
    """`df` with _number, _year, _kind, _short (the code as typed) and _code of the typed document number in `column`; null where the text does not tell them.

    Every step is a projection of its own, so that no step is evaluated twice.
    """
    own = df.columns
    keep = lambda frame, **new: frame.select(*own, *[c.alias(k) for k, c in new.items()])
    step = keep(df, _t=fold(F.col(column)))
    zero = F.regexp_replace("_t", r"(?<=[0-9])o(?=[o0-9]|[^a-z]|$)|(?<![a-z])o(?=[0-9])", "0")
    for _ in range(3):
        step = keep(step, _t=F.when(F.col("_t").rlike("[0-9]o|o[0-9]"), zero).otherwise(F.col("_t")))
    long = F.col("_t")
    for name, short in KINDS:
        long = F.regexp_replace(long, name.replace(" ", r"\s*"), f" {short} ")
    step = keep(step, _t=long)
    step = keep(
        step,
        _t=F.col("_t"),
        _digits=F.regexp_extract_all("_t", F.lit(r"([0-9]+)"), 1),
        _kind=F.regexp_extract("_t", r"(?<![a-z])(qd|nq|tt|ct)(?![a-z])", 1),
        _after=F.regexp_extract("_t", r"(?<![a-z])(?:qd|nq|tt|ct)[^a-z0-9]+(?!(?:so|vb|hieu|cua|ban|sao)(?![a-z]))([a-z]{2,9})(?![a-z])", 1),
        _before=F.regexp_extract("_t", r"(?<![a-z])(?!(?:so|vb|hieu|cua|ban|sao)(?![a-z]))([a-z]{2,9})[^a-z0-9]+(?:qd|nq|tt|ct)(?![a-z])", 1),
        _words=F.trim(F.regexp_replace(F.regexp_replace("_t", r"(?<![a-z])(?:qd|nq|tt|ct|so|cua|hieu|vb|ban sao)(?![a-z])|[^a-z]", " "), r"\s+", " ")),
    )
    first, second = F.get("_digits", F.lit(0)), F.get("_digits", F.lit(1))
    swapped = first.rlike("^(?:19|20)[0-9]{2}$") & ~second.rlike("^(?:19|20)?[0-9]{2}$")
    typed_year = F.when(swapped, first).otherwise(second)
    step = keep(
        step,
        _number=F.regexp_replace(F.when(swapped, second).otherwise(first), "^0+(?=[0-9])", ""),
        _year=F.when(F.length(typed_year) == 4, typed_year).when(F.length(typed_year) == 2, F.concat(F.when(typed_year >= "50", F.lit("19")).otherwise(F.lit("20")), typed_year)),
        _kind=F.when(F.col("_kind") != "", F.col("_kind")),
        _short=F.when(F.col("_words").contains(" ") & F.exists(F.array(*[F.lit(n) for n, _ in known.names]), lambda n: F.contains(F.col("_words"), n)), F.lit("")).when(F.length("_words") > 12, F.lit("")).when(F.col("_after") != "", F.col("_after")).otherwise(F.col("_before")),
        _words=F.col("_words"),
    )
    parts = ["_number", "_year", "_kind", "_short"]
    exact = F.array(*[F.lit(c) for c in known.codes])
    by_code = F.filter(_scored(F.col("_short"), [(c, c) for c in known.codes]), lambda o: o["d"] <= 1)
    by_name = F.filter(_scored(F.col("_words"), list(known.names)), lambda o: o["d"] <= F.length("_words") / 5)
    inside = F.transform(
        F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in known.names]), lambda o: F.contains(F.col("_words"), o["n"])),
        lambda o: F.struct(F.lit(0).alias("d"), o["c"].alias("v")),
    )
    one = lambda v: F.array(F.struct(F.lit(0).alias("d"), v.alias("v")))
    near = (
        F.when(F.array_contains(exact, F.col("_short")), one(F.col("_short")))
        .when(F.col("_short") != "", by_code)
        .when(F.length("_words") >= 6, F.when(F.size(inside) > 0, inside).otherwise(by_name))
    )
    step = keep(step, **{p: F.col(p) for p in parts}, _near=near)
    best = F.array_min("_near")
    step = keep(step, **{p: F.col(p) for p in parts}, _near=F.array_distinct(F.transform(F.filter("_near", lambda o: o["d"] == best["d"]), lambda o: o["v"])))
    return keep(step, **{p: F.col(p) for p in parts}, _code=F.when(F.size("_near") == 1, F.get("_near", F.lit(0))))


def with_number_key(df: DataFrame, column: str, known: Issuers, name: str = "key") -> DataFrame:
    """`df` with the canonical key `number/year/kind-code`; the trimmed lower-case text where a part cannot be told, "" for null."""
    own = df.columns
    parted = with_number_parts(df, column, known)
    full = F.concat(F.col("_number"), F.lit("/"), F.col("_year"), F.lit("/"), F.col("_kind"), F.lit("-"), F.col("_code"))
    return parted.select(*own, F.coalesce(full, F.lower(F.trim(F.col(column))), F.lit("")).alias(name))
