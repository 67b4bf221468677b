"""Row-wise expressions: dates, names, masks, probabilities, ranges, maps and arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Absolute and relative tolerance of "the same number".
ATOL, RTOL = 1e-8, 1e-5

# Codes for country names whose code is missing in the boundary table.
MISSING_ISO3 = {"France": "FRA", "Norway": "NOR", "Somaliland": "SOM", "Kosovo": "XKX", "Baikonur": "KAZ",
                "N. Cyprus": "CYP"}


def isclose(x: Column, value) -> Column:
    v = value if isinstance(value, Column) else F.lit(float(value))
    return F.abs(x - v) <= ATOL + RTOL * F.abs(v)


# --- dates and names -------------------------------------------------------------------------------------

def yday_to_date(year: Column, yday: Column) -> Column:
    return F.when(yday >= 1, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (yday - 1).cast("int")))


def month_bounds(year: Column, month: Column) -> dict[str, Column]:
    first = F.make_date(year, month, F.lit(1))
    return {"first_date": first, "last_date": F.last_day(first)}


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parse_layer_name(path: Column) -> dict[str, Column]:
    """Product, date and tile of a layer file name; NULL where the name lacks the part."""
    name = base_name(path)

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))

    stamp = part(r"([12]\d{6})")
    return {"product": part(r"^([^.]+)"),
            "date": yday_to_date(F.substring(stamp, 1, 4).cast("int"), F.substring(stamp, 5, 3).cast("int")),
            "h": part(r"h(\d\d)v\d\d").cast("int"), "v": part(r"h\d\dv(\d\d)").cast("int")}


def tile_name(h: Column, v: Column) -> Column:
    return F.format_string("h%02dv%02d", h, v)


def regex_like(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def regex_extract(x: Column, pattern: str, group: int = 0) -> Column:
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def to_date_strict(x: Column) -> Column:
    return F.to_date(x, "yyyy-MM-dd")


def crc_id(x: Column) -> Column:
    return F.upper(F.hex(F.crc32(x.cast("binary"))))


def crc_of_fields(fields: Column) -> Column:
    """Id of a map<string,string>, independent of the order of its entries."""
    lines = F.transform(F.array_sort(F.map_entries(fields)),
                        lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(",\n")))
    return crc_id(F.array_join(lines, ""))


# --- masks and values ------------------------------------------------------------------------------------

def qa_ok(qa: Column, legacy: bool = False) -> Column:
    """Burned-area quality: land, valid, full period, and no special condition 1..5.

    ``legacy`` looks at the special condition only.
    """
    code_ok = ~F.shiftright(qa, 5).between(1, 5)
    return code_ok if legacy else (qa.bitwiseAND(F.lit(3)) == 3) & (qa.bitwiseAND(F.lit(4)) == 0) & code_ok


def one_hot(x: Column, values: Sequence[int], prefix: str = "x_lct_") -> list[Column]:
    return [(x == k).alias(f"{prefix}{k}") for k in values]


def nodata_to_null(x: Column, values: Sequence[float]) -> Column:
    hit = reduce(lambda a, b: a | b, [isclose(x, v) for v in values])
    return F.when(~hit & ~F.isnan(x), x)


def recode(x: Column, mapping: Mapping[float, float]) -> Column:
    out = x
    for old, new in reversed(list(mapping.items())):
        out = F.when(isclose(x, old), F.lit(float(new))).otherwise(out)
    return out


def zero_to_minus_one(x: Column) -> Column:
    return F.when(F.abs(x) <= ATOL, F.lit(-1.0)).otherwise(x)


def fill_country_code(iso3: Column, name: Column) -> Column:
    """A missing code becomes the code known for the name, or the name itself."""
    known = F.create_map(*[F.lit(k) for kv in MISSING_ISO3.items() for k in kv])
    return F.when(iso3 == "-99", F.coalesce(F.try_element_at(known, name), name)).otherwise(iso3)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def expand_range(lo: Column, hi: Column, by: float, relative: bool = False) -> dict[str, Column]:
    pad = (hi - lo) * by if relative else F.lit(by)
    return {"lo": lo - pad, "hi": hi + pad}


def bin_mid(b: Column) -> Column:
    return (b["lo"] + b["hi"]) / 2


# --- probabilities ---------------------------------------------------------------------------------------

def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, closed: bool = False, on_error: str = "null") -> Column:
    """Inverse sigmoid. ``closed`` admits 0 and 1, which give infinities."""
    ok = (p >= 0) & (p <= 1) if closed else (p > 0) & (p < 1)
    value = F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).otherwise(
        F.log(p) - F.log(1 - p)) if closed else F.log(p) - F.log(1 - p)
    if on_error == "raise":
        return F.when(ok, value).when(p.isNotNull(), F.raise_error(F.lit("probability out of range")).cast("double"))
    return F.when(ok, value)


def odds(p: Column) -> Column:
    return F.when(p == 1, F.lit(float("inf"))).otherwise(F.try_divide(p, 1 - p))


def odds_to_proba(o: Column) -> Column:
    return o / (o + 1)


def keep_neg_rate(r_sampled, r_original) -> Column:
    """Share of negatives kept when undersampling moved the positive rate from original to sampled."""
    s = r_sampled if isinstance(r_sampled, Column) else F.lit(float(r_sampled))
    o = r_original if isinstance(r_original, Column) else F.lit(float(r_original))
    return odds(o) / odds(s)


def adjust_mean(mean: Column, knr) -> Column:
    """Positive rate of a bin before undersampling its negatives."""
    k = knr if isinstance(knr, Column) else F.lit(float(knr))
    return F.when(mean == 1, F.lit(1.0)).otherwise(odds_to_proba(odds(mean) * k))


def undo_oversampling(p: Column, original, sampled) -> Column:
    return adjust_mean(p, keep_neg_rate(sampled, original))


def linear_clip_proba(z: Column, start: float = 0.0, slope: float = 1.0, p_max: float = 1.0) -> Column:
    return clamp((z + start) * slope) * p_max


def sigmoid_proba(z: Column, center: float = 0.0, slope: float = 1.0, p_max: float = 1.0) -> Column:
    return sigmoid((z - center) * slope) * p_max


def level_fire_proba(rain: Column, temp: Column) -> Column:
    return clamp(0.2 * temp - 0.25 * rain)


def noisy_or_score(h0: Column, h1: Column, h2: Column, h3: Column, h4: Column, spread: Column, shift: Column,
                   link=sigmoid) -> dict[str, Column]:
    """Flammability times ignition, ignition being a noisy OR of an own source and spread from neighbours."""
    p_f = sigmoid(h0 - h1 + shift)
    p_i = clamp(h4 * (1 - (1 - link(h2)) * (1 - h3 * spread)))
    return {"p_f": p_f, "p_i": p_i, "p": p_f * p_i}


def linear(xs: Sequence[Column], weights: Sequence, bias) -> Column:
    terms = [x * (w if isinstance(w, Column) else F.lit(float(w))) for x, w in zip(xs, weights, strict=True)]
    return reduce(lambda a, b: a + b, terms) + (bias if isinstance(bias, Column) else F.lit(float(bias)))


def score_product(x_f: Sequence[Column], w_f: Sequence, b_f, x_i: Sequence[Column], w_i: Sequence, b_i) -> dict[str, Column]:
    """Two-branch score; an ignition branch without features sees a constant 1."""
    p_f = sigmoid(linear(x_f, w_f, b_f))
    p_i = sigmoid(linear(list(x_i) or [F.lit(1.0)], w_i, b_i))
    return {"p_f": p_f, "p_i": p_i, "p": p_f * p_i}


def score_mlp(xs: Sequence[Column], layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]) -> Column:
    """Sigmoid network with given weights: each layer is (rows of weights, biases); the last has one row.

    Activations travel as an array, so every hidden value is computed once per row.
    """
    act = F.array(*xs)
    for rows, biases in layers:
        w = F.array(*[F.array(*[F.lit(float(k)) for k in row]) for row in rows])
        b = F.array(*[F.lit(float(k)) for k in biases])

        def layer(prev: Column, w: Column = w, b: Column = b) -> Column:
            return F.zip_with(w, b, lambda row, bias: sigmoid(F.aggregate(
                F.zip_with(row, prev, lambda p, q: p * q), bias, lambda acc, t: acc + t)))

        act = layer(act)
    return act[0]


def scale_process_params(mu2: Column, var2: Column, cov12: Column, f_mu: float, f_var: float) -> dict[str, Column]:
    return {"mu2": mu2 * f_mu, "var2": F.pow(F.sqrt(var2) * f_var, F.lit(2.0)),
            "var12": F.signum(cov12) * F.pow(F.sqrt(F.abs(cov12)) * f_var, F.lit(2.0))}


# --- arrays, maps, schemas -------------------------------------------------------------------------------

def pick_elements(values: Column, mask: Column) -> Column:
    pairs = F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"])


def negate(mask: Column) -> Column:
    return F.transform(mask, lambda m: ~m)


def drop_map_keys(m: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(list(keys)))


def recycle(values: Column, n: Column) -> Column:
    """Repeat an array up to length n; n has to be a multiple of its length."""
    size = F.size(values)
    times = F.when((size > 0) & (n % size == 0), (n / size).cast("int")).otherwise(
        F.raise_error(F.lit("length does not divide n")).cast("int"))
    return F.flatten(F.array_repeat(values, times))


def stack_columns(names: Sequence[str]) -> Column:
    return F.array(*names)


def unstack_columns(values: Column, names: Sequence[str]) -> list[Column]:
    return [F.get(values, F.lit(k)).alias(n) for k, n in enumerate(names)]


def flatten_columns(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs become plain columns named by their path."""

    def walk(prefix: str, name: str, t: T.DataType):
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from walk(f"{prefix}.`{f.name}`", f"{name}{sep}{f.name}", f.dataType)
        else:
            yield F.col(prefix).alias(name)

    return df.select(*[c for f in df.schema.fields for c in walk(f"`{f.name}`", f.name, f.dataType)])


def rename_to_generic(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"x{k}") for k, c in enumerate(features)], F.col(label).alias("fire"))


SAMPLE_COLUMNS = ("v", "h", "i2", "j2", "year", "yday", "lct")


def enforce_sample_schema(df: DataFrame) -> DataFrame:
    """Integer keys and a boolean label; fails while running when rows of two years are mixed."""
    one_year = df.agg((F.count_distinct("year") <= 1).alias("ok")).scalar()
    year = F.when(one_year, F.col("year").cast("int")).otherwise(
        F.raise_error(F.lit("samples of more than one year")).cast("int"))
    keys = [year.alias("year") if c == "year" else F.col(c).cast("int").alias(c) for c in SAMPLE_COLUMNS]
    rest = [c for c in df.columns if c not in (*SAMPLE_COLUMNS, "fire")]
    return df.select(*keys, F.col("fire").cast("boolean").alias("fire"), *rest)
