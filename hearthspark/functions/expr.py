"""Column helpers of the registry: ages, labels, sort keys, identifiers, slugs, text fields. All stay inside Catalyst."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthspark.schemas import AGE_PRESETS, LABEL_CODES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(c: Column) -> Column:
    """a-z to A-Z and nothing else; all-ASCII texts take the built-in, which is much faster."""
    return F.when(F.octet_length(c) == F.length(c), F.upper(c)).otherwise(F.translate(c, _LOWER, _UPPER))


def ascii_lower(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def trim_ws(c: Column) -> Column:
    """Trims all white space, not just spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalized_key(c: Column) -> Column:
    """Lower case, trimmed, inner white space collapsed: the key of lookups by name."""
    return F.lower(trim_ws(F.regexp_replace(c, r"\s+", " ")))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def pad_left(c: Column, n: int, fill: str = "0") -> Column:
    """Pads and never truncates."""
    return F.when(F.length(c) < n, F.lpad(c, n, fill)).otherwise(c)


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def age_years(born: Column, as_of: date | Column) -> Column:
    """Completed years; a 29 February birthday is reached on 1 March of common years."""
    d = F.lit(as_of) if isinstance(as_of, date) else as_of
    early = (F.month(born) * 100 + F.dayofmonth(born)) > (F.month(d) * 100 + F.dayofmonth(d))
    return (F.year(d) - F.year(born) - early.cast("int")).cast("int")


def age_between(born: Column, as_of: date, low: int | None, high: int | None) -> Column:
    """Ages from ``low`` to ``high`` as a range of birth dates, which scans can prune by; None is open."""
    d, out = F.lit(as_of), born.isNotNull()
    if low is not None:
        out = out & (born <= F.add_months(d, -12 * low))
    if high is not None:
        out = out & (born > F.add_months(d, -12 * (high + 1)))
    return out


def age_preset(age: Column) -> Column:
    """Name of the preset that an age falls in."""
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(AGE_PRESETS.items()):
        out = F.when((age >= low) & (age <= high if high is not None else F.lit(True)), name).otherwise(out)
    return out


def label(code: Column, labels: dict[str, str], default: str | None = "-") -> Column:
    out = F.lit(default).cast("string")
    for key, text in reversed(labels.items()):
        out = F.when(code == key, text).otherwise(out)
    return out


def ordinal(code: Column, order: list[str]) -> Column:
    """Place of a code in its domain, from 1; null if it has none."""
    out = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(order, 1))):
        out = F.when(code == key, i).otherwise(out)
    return out


def canonical_enum(text: Column, codes: dict[str, str] = LABEL_CODES) -> Column:
    """Code of a label; blanks, dashes and unknown words are null."""
    return label(F.upper(trim_ws(text)), codes, None)


def natural_sort_key(c: Column) -> Column:
    """Sorts numbers inside texts by value, letters without case: runs of digits padded to 20."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), pad_left(x, 20)).otherwise(x)), "")


def area_label(kind: Column, code: Column, name: Column) -> Column:
    """``RW`` and the code (else the name, unless it says RW itself) of areas of that type; the name of others."""
    k, n, c = F.lower(F.trim(kind)), F.trim(F.coalesce(name, F.lit(""))), F.trim(code)
    rw = F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("RW "), c)).when(n.rlike(r"(?i)^rw\b"), n).otherwise(F.concat(F.lit("RW "), n))
    return F.when(k == "rw", rw).otherwise(n)


def rt_rw_label(area: Column, number: Column) -> Column:
    """``area / RT n`` of the parts that there are; null without any."""
    return F.nullif(F.concat_ws(" / ", area, F.concat(F.lit("RT "), number)), F.lit(""))


def format_count(n: Column, suffix: str = "") -> Column:
    """Thousands by dots."""
    return F.concat(F.translate(F.format_number(n, 0), ",", "."), F.lit(suffix))


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"))


def contains_any(columns: list[Column], query: str | None, escape: bool = False) -> Column:
    """Case-insensitive substring match in any column; a blank query matches all. % and _ in the query count as wildcards unless escaped; a backslash is itself."""
    q = (query or "").strip()
    if not q:
        return F.lit(True)
    q = q.replace("\\", "\\\\")
    if escape:
        q = q.replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.cast("string").ilike(f"%{q}%"), F.lit(False))
    return out


def mean_cents(amount: Column) -> Column:
    """Mean of an amount in whole cents, halves up, by integers only."""
    return _half_up(F.sum(F.round(amount * 100).cast("long")), F.count(amount))


def _half_up(total: Column, n: Column) -> Column:
    twice, double = 2 * total + n, 2 * n
    return ((twice - F.pmod(twice, double)) / double).cast("long")


def confidence_status(value: Column, threshold: float = 70) -> Column:
    return F.when(value >= threshold, "SUCCESS").otherwise("LOW_CONFIDENCE")


def confidence_band(value: Column) -> Column:
    return F.when(value >= 90, F.lit(None).cast("string")).when(value >= 70, "warning").otherwise("danger")


def normalize_lines(text: Column) -> Column:
    """Lines with any line break, no-break spaces as spaces, zero-width spaces gone, blanks collapsed, empty lines dropped."""
    one = F.replace(F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    return F.filter(F.transform(F.split(one, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(trim_ws(text), r"\s+"), lambda x: x != "")


def norm_token(token: Column) -> Column:
    """Upper case without marks at either end; a misread NIK is mended."""
    return norm_upper(ascii_upper(token))


def norm_upper(token: Column) -> Column:
    """norm_token() of a token in upper case."""
    return F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), "^N1K$", "NIK")


def repair_digits(text: Column) -> Column:
    """Letters that are misread digits."""
    return F.translate(text, "OoIilLSsBb", "0011115588")


def id16(text: Column, repair: bool = True) -> Column:
    """The first run of exactly sixteen digits, separators removed; empty if there is none."""
    t = F.regexp_replace(text, r"[\s.\-/]+", "")
    return F.regexp_extract(repair_digits(t) if repair else t, r"(?<!\d)(\d{16})(?!\d)", 1)


def rt_rw_pair(text: Column) -> tuple[Column, Column]:
    """Two short numbers with a slash or dash between them."""
    pattern = r"(\d{1,3})\s*[-/]\s*(\d{1,3})"
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def area_pair(text: Column) -> Column:
    """(rt, rw) as written, null where not found: numbers with the labels RT and RW in this order, else the first two with a slash or dash between them, else the only two of up to three digits.

    The text is read as words: runs of digits, the labels, and single marks. Of a longer run the three digits next to its label or mark count.
    """

    def read(t: Column) -> Column:
        number = lambda i: F.when(F.get(t, i).rlike("^[0-9]"), F.get(t, i))
        after = lambda i: F.coalesce(number(i + 1), F.when(F.get(t, i + 1).isin(":", "."), number(i + 2)))
        of = lambda label: F.transform(t, lambda x, i: F.when(x == label, after(i)))
        at = F.array_position(F.transform(of("RT"), lambda x: x.isNotNull()), True).cast("int")
        rt, rw = F.get(of("RT"), at - 1), F.get(F.filter(F.slice(of("RW"), at + 1, F.size(t)), lambda x: x.isNotNull()), F.lit(0))
        marked = F.transform(t, lambda x, i: F.when(x.isin("-", "/") & number(i - 1).isNotNull() & number(i + 1).isNotNull(), F.struct(F.right(number(i - 1), F.lit(3)).alias("rt"), F.left(number(i + 1), F.lit(3)).alias("rw"))))
        only = F.filter(t, lambda x: x.rlike("^[0-9]"))
        short = (F.size(only) == 2) & F.forall(only, lambda x: F.length(x) <= 3)
        labelled_ = F.when((at > 0) & rw.isNotNull(), F.struct(F.left(rt, F.lit(3)).alias("rt"), F.left(rw, F.lit(3)).alias("rw")))
        return F.coalesce(labelled_, F.get(F.filter(marked, lambda x: x.isNotNull()), F.lit(0)), F.when(short, F.struct(F.get(only, F.lit(0)).alias("rt"), F.get(only, F.lit(1)).alias("rw"))))

    words = F.regexp_extract_all(ascii_upper(text), F.lit(r"[0-9]+|RT|RW|\S"), F.lit(0))
    return F.get(F.transform(F.array(words), read), F.lit(0))


def area_number(text: Column) -> Column:
    """The first number of up to three digits, without leading zeros, of two digits at least; null without one."""
    raw = F.regexp_extract(repair_digits(text), r"(\d{1,3})", 1)
    return F.when(raw == "", F.lit(None)).otherwise(pad_left(raw.cast("int").cast("string"), 2))


def parse_date(text: Column, newest_year: int = 2100) -> Column:
    """The first day-month-year in a text, two-digit years below 70 in this century; null unless a real day from 1900 to ``newest_year``."""
    pattern = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"

    def read(y: Column) -> Column:
        year = F.when(F.length(y) == 2, F.when(y.cast("int") < 70, y.cast("int") + 2000).otherwise(y.cast("int") + 1900)).otherwise(F.nullif(y, F.lit("")).cast("int"))
        day = F.try_to_date(F.concat_ws("-", year.cast("string"), F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 1)), "y-M-d")
        return F.when((y != "") & year.between(1900, newest_year), day)

    # Inside a lambda nothing is shared: the year is read once.
    return F.get(F.transform(F.array(F.regexp_extract(text, pattern, 3)), read), F.lit(0))


def header_text(line: Column) -> Column:
    """A line in upper case, as labels are looked for in it."""
    return trim_ws(F.replace(ascii_upper(line), F.lit("N0MOR"), F.lit("NOMOR")))


def labelled(text: Column, name: str) -> Column:
    """Of a header_text(), the value after a label: ``LABEL x : value``, ``LABEL value`` or a bare label (empty value); null if the line has another label."""
    rest = F.substr(text, F.lit(len(name) + 1))
    before = trim_ws(F.substring_index(rest, ":", 1))  # of the colon: nothing, or one letter or digit that a misread mark left
    colon = F.contains(rest, F.lit(":")) & ((before == "") | ((F.length(before) == 1) & before.between("0", "Z") & before.rlike("[0-9A-Z]")))
    value = F.when(colon, F.ltrim(F.substr(rest, F.instr(rest, ":") + 1))).when(F.substr(rest, F.lit(1), F.lit(1)).isin(" ", "\t"), F.ltrim(rest)).when(rest == "", F.lit(""))
    return F.when(text.startswith(name), value)


def header_value(line: Column, name: str) -> Column:
    """labelled() of a line as it is."""
    return labelled(header_text(line), name)


def mime_type(content: Column) -> Column:
    """By magic bytes: JPEG, PNG or PDF; null for others."""
    return F.when(F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF")), "image/jpeg").when(F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "image/png").when(F.substring(content, 1, 5) == F.unhex(F.lit("255044462D")), "application/pdf")
