"""Column helpers for the functions of the source system's expression language.

Arguments are typed columns.  A wrong type is an analysis error instead of a
run-time one; what only data can show (text that is no number, invalid JSON, an
invalid time) raises through ``raise_error`` unless ``strict=False``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json
from tidemark.functions.patterns import SPACE, char_class
from tidemark.functions.stats import half_up

SPACES = f"[\\s{char_class(SPACE)}]"


def _raise(message: str, dtype: str) -> Column:
    return F.raise_error(F.lit(message)).cast(dtype)


# ------------------------------------------------------------ text and arrays
def length_of_text(v: Column) -> Column:
    """UTF-16 length (characters beyond the basic plane count twice); null is 0."""
    wide = F.length(F.regexp_replace(v, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.coalesce(F.length(v) + wide, F.lit(0))


def length_of(v: Column) -> Column:
    """Size of an array or a map; null is 0."""
    return F.coalesce(F.when(v.isNotNull(), F.size(v)), F.lit(0))


lower, upper = F.lower, F.upper


def trim(v: Column) -> Column:
    """Strip all white space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(v, f"^{SPACES}+", ""), f"{SPACES}+$", "")


def contains_text(hay: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(hay, needle), F.lit(False))


def contains_item(hay: Column, item: Column) -> Column:
    """Membership by value; null is an ordinary item."""
    return F.coalesce(F.exists(hay, lambda x: x.eqNullSafe(item)), F.lit(False))


starts_with, ends_with = F.startswith, F.endswith


def display_number(v: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    d = v.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9e15)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def join(items: Column, sep: str = ",") -> Column:
    """Join text items; null shows as nothing."""
    return F.array_join(F.transform(items, lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep)


def split(v: Column, sep: str) -> Column:
    """Split at a literal separator; an empty one gives the characters."""
    if sep == "":
        return F.filter(F.split(v, ""), lambda x: x != "")
    return F.split(v, r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E")


def replace(v: Column, old: Column | str, new: Column | str) -> Column:
    """Replace every literal occurrence."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.replace(v, lit(old), lit(new))


def _bounds(n: Column, start: int, end: int | None) -> tuple[Column, Column]:
    lo = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    hi = n if end is None else F.lit(end) if end >= 0 else F.greatest(F.lit(0), n + end)
    hi = F.least(hi, n)
    return lo, F.greatest(F.lit(0), hi - lo)


def slice_text(v: Column, start: int, end: int | None = None) -> Column:
    """Part of a text: counted from 0, negative from the end, end excluded."""
    lo, size = _bounds(F.length(v), start, end)
    return F.substring(v, lo + 1, size)


def slice_items(v: Column, start: int, end: int | None = None) -> Column:
    lo, size = _bounds(F.size(v), start, end)
    return F.slice(v, lo + 1, size)


def keys(m: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))


def values(m: Column) -> Column:
    """Values in the order of the sorted keys."""
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k))


def pluck(maps: Column, key: str) -> Column:
    """One member of every map of an array; null where it is missing."""
    return F.transform(maps, lambda m: F.try_element_at(m, F.lit(key)))


def first(v: Column) -> Column:
    return F.try_element_at(v, F.lit(1))


def last(v: Column) -> Column:
    return F.try_element_at(v, F.lit(-1))


unique = F.array_distinct  # keeps the first of equals
sort = F.array_sort  # numbers by value, text by code point


# --------------------------------------------------------------------- numbers
def sum_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


min_of, max_of = F.array_min, F.array_max  # null for an empty array


def round_half_up(v: Column, digits: int = 0) -> Column:
    return half_up(v, digits)


floor, ceil, abs_ = F.floor, F.ceil, F.abs


def to_number(v: Column, strict: bool = True) -> Column:
    """Text to number; blank or malformed text raises."""
    t = trim(v)
    n = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    n = F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double")).otherwise(n)
    return F.coalesce(n, _raise("toNumber() could not convert the value", "double")) if strict else n


def to_text(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit(""))


def to_json(json: Column) -> Column:
    """Canonical JSON of a JSON text."""
    return canonical_json(json)


def try_json(text: Column) -> Column:
    """Parsed JSON, or null.  Spark's parser stops after the first value, so text that
    goes on is told apart by parsing it once inside brackets and once inside braces."""
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.try_variant_get(item, "$[1]", "variant").isNull() & F.try_variant_get(item, "$[0]", "variant").isNotNull()
    return F.when(one & member.isNotNull(), F.try_variant_get(item, "$[0]", "variant"))


def from_json(text: Column, strict: bool = True) -> Column:
    """Parsed JSON; malformed text raises, or gives null when not strict."""
    v = try_json(text)
    return F.when(v.isNotNull() | text.isNull(), v).otherwise(F.parse_json(F.concat(F.lit("invalid JSON: "), text))) if strict else v


is_null = F.isnull


def hash_text(v: Column) -> Column:
    return F.sha2(v, 256)


def hash_json(json: Column) -> Column:
    return F.sha2(canonical_json(json), 256)


def uuid_of(seed: Column, label: Column | str = "") -> Column:
    """UUID-shaped text that follows from a seed and a label."""
    lab = F.lit(label) if isinstance(label, str) else label
    h = F.sha2(F.concat(F.lit("uuid:"), seed, F.lit(":"), lab), 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


# ------------------------------------------------------------------------ time
def parse_time(iso: Column, strict: bool = True) -> Column:
    t = F.try_to_timestamp(iso)
    return F.coalesce(t, _raise("invalid timestamp", "timestamp")) if strict else t


def date_add_ms(t: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(t) + ms)


def day_of(t: Column) -> Column:
    return F.to_date(t)


epoch_ms = F.unix_millis

# Duration units in milliseconds, the accepted short form and the accepted ISO 8601 form
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
_SHORT = r"(\d+(?:\.\d+)?)(ms|s|m|h|d|w)"
_ISO = r"(?i)^P(?=[\dT])(?:(\d+)W)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def duration_ms(text: Column, strict: bool = True) -> Column:
    """``250ms``, ``1h30m`` or ``PT1H30M`` to milliseconds."""
    t = trim(text)
    units = F.create_map(*[F.lit(x) for kv in UNIT_MS.items() for x in kv])
    amounts = F.regexp_extract_all(t, F.lit(_SHORT), 1)
    names = F.regexp_extract_all(t, F.lit(_SHORT), 2)
    plain = F.aggregate(F.zip_with(amounts, names, lambda a, u: a.cast("double") * F.element_at(units, u)), F.lit(0.0), lambda a, x: a + x)
    piece = lambda i, ms: F.coalesce(F.regexp_extract(t, _ISO, i).try_cast("double"), F.lit(0.0)) * ms
    iso = piece(1, 604_800_000) + piece(2, 86_400_000) + piece(3, 3_600_000) + piece(4, 60_000) + piece(5, 1000)
    ms = F.when(t.rlike(_ISO), iso).when(t.rlike(f"^(?:{_SHORT})+$"), plain)
    ms = F.floor(ms + 0.5).cast("bigint")
    return F.coalesce(ms, _raise("not a duration", "bigint")) if strict else ms


def duration_text(ms: Column) -> Column:
    """``1d2h3m4s``; below a second ``250ms``."""
    s = F.floor(ms / 1000 + 0.5).cast("bigint")
    part = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    whole = lambda x, size: F.floor(x / size).cast("bigint")
    text = F.concat(part(whole(s, 86400), "d"), part(whole(s % 86400, 3600), "h"), part(whole(s % 3600, 60), "m"), part(s % 60, "s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(text)


# ------------------------------------------------------------------- operators
def truthy_text(v: Column) -> Column:
    return F.coalesce(v != "", F.lit(False))


def truthy_number(v: Column) -> Column:
    return F.coalesce((v != 0) & ~F.isnan(v.cast("double")), F.lit(False))


def truthy(v: Column) -> Column:
    return F.coalesce(v, F.lit(False))


def compare(left: Column, op: str, right: Column) -> Column:
    """Ordering that is false, not null, when a side is null."""
    hit = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(hit, F.lit(False))


def equals(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)


def divide(left: Column, right: Column) -> Column:
    zero = F.raise_error(F.lit("Division by zero")).cast("double")
    return F.when(right == 0, zero).otherwise(left.cast("double") / right)


def modulo(left: Column, right: Column) -> Column:
    """Remainder with the sign of the dividend."""
    zero = F.raise_error(F.lit("Division by zero")).cast("double")
    return F.when(right == 0, zero).otherwise(left.cast("double") % right)


def both(left: Column, right: Column, test=truthy) -> Column:
    """``left && right``: the right operand when the left is truthy, else the left."""
    return F.when(test(left), right).otherwise(left)


def either(left: Column, right: Column, test=truthy) -> Column:
    return F.when(test(left), left).otherwise(right)


def index(items: Column, i: Column | int) -> Column:
    """0-based item; null outside the array or for a negative index."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.when(at >= 0, F.get(items, at))


def render(template: str, **columns: Column) -> Column:
    """Fill ``${{ name }}`` places; a null inside text raises, ``$${{`` stands for itself."""
    import re

    pieces: list[Column] = []
    at = 0
    pattern = re.compile(r"\$?\$\{\{\s*(\w+)\s*\}\}")
    whole = pattern.fullmatch(template)
    if whole and not template.startswith("$$"):
        return columns[whole.group(1)]  # the value itself, with its type
    for m in pattern.finditer(template):
        pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m.group(0).startswith("$$"):
            pieces.append(F.lit(m.group(0)[1:]))
        else:
            c = columns[m.group(1)].cast("string")
            pieces.append(F.coalesce(c, _raise(f"'{m.group(1)}' is null inside a string", "string")))
    return F.concat(*pieces, F.lit(template[at:]))


def code_unit_key(v: Column) -> Column:
    """Sort key for UTF-16 code unit order: differs from code point order beyond the basic plane."""
    return F.encode(v, "UTF-16BE")


def locale_key(v: Column) -> Column:
    return F.collate(v, "UNICODE")
