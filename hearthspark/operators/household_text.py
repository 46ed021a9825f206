"""Household records from scanned text: a projection of each row on arrays, no shuffle and no Python in the tasks.

A document's lines are an array. Labels before the members' table give the household's fields, the first value of each wins. In the table, a line with a
sixteen-digit number begins a member, following lines continue it, numbered lines without such a number end it. A member's fields are found in its token array by
position and in its words by the longest known phrase. Rows don't meet, so ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.functions import expr as E

# Fixed values, down to UNREADABLE: labels in the order they are tried, words of the tables' vocabulary, codes, misread words, markers, headings, a message's ending, thresholds.
HEADER_LABELS = {
    "NOMOR_KARTU_KELUARGA": "NOMOR KARTU KELUARGA", "NOMOR_KK": "NOMOR KK", "NO_KK": "NO KK", "RT_RW": "RT/RW", "LINGKUNGAN": "LINGKUNGAN", "ALAMAT": "ALAMAT", "RT": "RT", "RW": "RW",
}
VOCABULARY = {
    "religion": ["ISLAM", "KRISTEN", "KATOLIK", "HINDU", "BUDDHA", "KONGHUCU"],
    "education": [
        "TIDAK/BELUM SEKOLAH", "BELUM TAMAT SD/SEDERAJAT", "TAMAT SD/SEDERAJAT", "AKADEMI/DIPLOMA III/SARJANA MUDA", "DIPLOMA IV/STRATA I", "DIPLOMA I/II",
        "SLTP/SEDERAJAT", "SLTA/SEDERAJAT", "SD", "SMP", "SMA", "D1", "D2", "D3", "S1", "S2", "S3",
    ],
    "occupation": [
        "PEGAWAI NEGERI SIPIL", "IBU RUMAH TANGGA", "BURUH HARIAN LEPAS", "KARYAWAN SWASTA", "PELAJAR/MAHASISWA", "PETANI", "PEDAGANG", "NELAYAN", "WIRASWASTA",
        "PENSIUNAN", "PELAJAR", "MAHASISWA", "BURUH", "TUKANG", "LAINNYA",
    ],
    "marital_status": ["BELUM KAWIN", "CERAI HIDUP", "CERAI MATI", "KAWIN"],
    "family_relation": ["KEPALA KELUARGA", "ORANG TUA", "FAMILI LAIN", "MENANTU", "CUCU", "MERTUA", "ISTRI", "ANAK", "LAINNYA"],
}
#: Fields whose values are codes, with underscores.
CODED = ("marital_status", "family_relation")
ALIASES = {"N1K": "NIK", "KAT0LIK": "KATOLIK", "KR1STEN": "KRISTEN", "H1NDU": "HINDU", "BUDHHA": "BUDDHA", "KAW1N": "KAWIN", "1STRI": "ISTRI", "AN4K": "ANAK"}
END_MARKERS = ["KETERANGAN", "PENJELASAN", "CATATAN", "DITETAPKAN DI", "MENGETAHUI", "KEPALA DINAS", "KEPALA DESA", "LURAH", "CAMAT"]
NOISE = ["NO", "NAMA", "NIK", "JENIS KELAMIN", "TEMPAT LAHIR", "TANGGAL LAHIR", "AGAMA", "PENDIDIKAN", "PEKERJAAN", "STATUS PERKAWINAN", "STATUS HUBUNGAN DALAM KELUARGA"]
KEPT = " Nilai pertama dipertahankan."
THRESHOLD, UNREADABLE = 70, 30

_ID = r"^\d{16}$"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Of a line in upper case: white space other than single blanks, a mark at an end of a token, or a misread NIK. Without them its tokens are what stands between its blanks.
_ODD = r"(?:^|\s)[^\p{L}\p{N}]|[^\p{L}\p{N}](?:\s|$)|[^\S ]|N1K|^$"
#: Of a line: digits of two tokens side by side, which may be short numbers.
_BESIDE = r"\d[^\p{L}\p{N}]*\s[^\p{L}\p{N}]*\d"


def line_tokens(line: Column, upper: Column | None = None) -> Column:
    """Array of (raw, norm) of a line (and the same in upper case); runs of two or more short numbers with sixteen digits together are one token."""
    upper = E.ascii_upper(line) if upper is None else upper
    zipped = lambda xs, ys, norm: F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("raw"), norm(y).alias("norm")))
    pairs = F.when(upper.rlike(_ODD), zipped(E.tokens(line), E.tokens(upper), E.norm_upper)).otherwise(zipped(F.split(line, " "), F.split(upper, " "), lambda y: y))
    return F.when(upper.rlike(_BESIDE), _bound(pairs, _joined_runs)).otherwise(pairs)


def _joined_runs(pairs: Column) -> Column:
    """Runs of short numbers with sixteen digits together as one token. Only what stands between such runs is copied."""
    none, raw = F.lit(False), lambda xs: F.array_join(F.transform(xs, lambda x: x["raw"]), "")

    def runs(short: Column) -> Column:
        first = lambda x, i: x & ~F.coalesce(F.get(short, i - 1), none) & F.coalesce(F.get(short, i + 1), none)
        starts = F.filter(F.transform(short, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())
        end = lambda i: F.coalesce(i - 1 + F.nullif(F.array_position(F.slice(short, i + 1, F.size(short)), False).cast("int"), F.lit(0)), F.size(short))
        found = F.transform(F.transform(starts, lambda i: F.struct(i.alias("s"), end(i).alias("e"))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), raw(F.slice(pairs, x["s"] + 1, x["e"] - x["s"])).alias("whole")))
        return F.filter(found, lambda x: F.length(x["whole"]) == 16)

    def merged(found: Column) -> Column:
        end = lambda j: F.coalesce(F.get(found, j)["e"], F.lit(0))
        parts = F.transform(found, lambda x, j: F.concat(F.slice(pairs, end(j - 1) + 1, x["s"] - end(j - 1)), F.array(F.struct(x["whole"].alias("raw"), x["whole"].alias("norm")))))
        last = end(F.size(found) - 1)
        return F.when(F.size(found) == 0, pairs).otherwise(F.concat(F.flatten(parts), F.slice(pairs, last + 1, F.size(pairs) - last)))

    return _bound(_bound(F.transform(pairs, lambda x: x["norm"].rlike(r"^\d{1,6}$")), runs), merged)


def tsv_text(words: DataFrame, key: str) -> DataFrame:
    """(key, raw_text, confidence, word_count) of an OCR engine's word table: words of level 5 with a text and a confidence of zero or more."""
    good = words.filter((F.col("level") == 5) & (F.col("conf") >= 0) & (E.trim_ws(F.coalesce("text", F.lit(""))) != ""))
    place = ["page_num", "block_num", "par_num", "line_num"]
    lines = good.groupBy(key, *place).agg(F.array_sort(F.collect_list(F.struct("word_num", "text"))).alias("w"), F.sum("conf").alias("conf"))
    lines = lines.withColumn("line", F.array_join(F.transform("w", lambda x: E.trim_ws(x["text"])), " ")).withColumn("n", F.size("w"))
    texts = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*place, "line"))).alias("l"), F.sum("conf").alias("c"), F.sum("n").alias("n"))
    found = texts.select(F.col(key).alias("_k"), F.array_join(F.col("l.line"), "\n").alias("_t"), F.round(F.col("c") / F.col("n"), 2).alias("_c"), F.col("n").cast("int").alias("_n"))
    return words.select(key).distinct().join(found, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_t", F.lit("")).alias("raw_text"), F.coalesce("_c", F.lit(0.0)).alias("confidence"), F.coalesce("_n", F.lit(0)).alias("word_count"))


def _with(df: DataFrame, column: str, keep: str, **fields: Callable[[Column], Column]) -> DataFrame:
    """Each struct of an array with its fields ``keep`` and new ones. A step copies what it keeps, so fields are made several at a time and let go when used."""
    return df.withColumn(column, F.transform(column, lambda x: F.struct(*[x[k].alias(k) for k in keep.split()], *[f(x).alias(name) for name, f in fields.items()])))


def _has(line: Column, word: str) -> Column:
    """Whether a line (of those with ``up`` and ``t``) has a word among its tokens."""
    return F.contains(line["up"], F.lit(word)) & F.exists(line["t"], lambda x: x["norm"] == word)


def _is_id(token: Column) -> Column:
    return (F.length(token["norm"]) == 16) & token["norm"].rlike(_ID)


def _lines(docs: DataFrame) -> DataFrame:
    """``lines``, array of (i, line, up: the line in upper case, t: tokens); ``blank`` without any; ``h``: place of the table's heading, null without one: a line with NIK, NAMA in it or beside it."""
    df = docs.withColumn("_l", E.normalize_lines(F.coalesce("raw_text", F.lit(""))))
    df = df.withColumn("lines", F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("line"), E.ascii_upper(x).alias("up")))).withColumn("blank", F.size("lines") == 0).drop("_l")
    df = _with(df, "lines", "i line up", t=lambda x: line_tokens(x["line"], x["up"]))
    df = df.withColumn("_nama", F.transform("lines", lambda x: _has(x, "NAMA")))
    near = lambda i: F.coalesce(F.get("_nama", i), F.lit(False))
    at = F.array_position(F.transform("lines", lambda x, i: (_has(x, "NIK") | (F.contains(x["up"], F.lit("N1K")) & F.exists(x["t"], lambda y: y["norm"] == "NIK"))) & (near(i - 1) | near(i) | near(i + 1))), True).cast("int")
    return df.withColumn("h", F.nullif(at, F.lit(0)) - 1).drop("_nama")


_KK = ("NOMOR_KARTU_KELUARGA", "NOMOR_KK", "NO_KK")


def _header(df: DataFrame) -> DataFrame:
    """The household's fields, the first value of each, and ``hw``, warnings by line."""
    # The first label that fits, by number, then its value.
    number = lambda x: F.array_position(F.array(*[E.labelled(x["text"], name).isNotNull() for name in HEADER_LABELS.values()]), True).cast("int")
    nth = lambda n, values: F.get(F.array(*values), n - 1)
    text = lambda x: F.coalesce(*[F.when(x["n"] == n, F.trim(E.labelled(x["text"], name))) for n, name in enumerate(HEADER_LABELS.values(), 1)])
    id16 = lambda x: F.coalesce(F.nullif(E.id16(x, repair=False), F.lit("")), F.nullif(E.id16(E.ascii_upper(x)), F.lit("")))
    is_kk, both = (lambda x: x["key"].isin(*_KK)), (lambda x: x["key"] == "RT_RW")
    pair = lambda x, of: E.area_pair(x["value"])[of]
    short = lambda x: E.area_number(F.translate(E.ascii_upper(x["value"]), "OIL", "011"))
    df = df.withColumn("hl", F.slice("lines", F.lit(1), F.coalesce("h", F.size("lines"))))
    df = _with(df, "hl", "i line t", next=lambda x: F.get("lines", x["i"] + 1)["line"], text=lambda x: E.trim_ws(F.replace(x["up"], F.lit("N0MOR"), F.lit("NOMOR"))))
    df = _with(df, "hl", "i line t next text", n=number)
    df = _with(df, "hl", "i line t next", key=lambda x: nth(x["n"], map(F.lit, HEADER_LABELS)), value=lambda x: F.nullif(text(x), F.lit("")))
    df = _with(
        df, "hl", "i line t key value", kk_number=lambda x: F.when(is_kk(x), F.coalesce(id16(x["value"]), F.when(x["value"].isNull(), id16(x["next"])))),
        address=lambda x: F.when(x["key"] == "ALAMAT", x["value"]), rt=lambda x: F.when(both(x), E.area_number(pair(x, "rt"))).when(x["key"] == "RT", short(x)),
        rw=lambda x: F.when(both(x), E.area_number(pair(x, "rw"))).when(x["key"] == "RW", short(x)),
        lingkungan=lambda x: F.when(x["key"] == "LINGKUNGAN", F.regexp_replace(F.regexp_replace(x["value"], r"\s+", " "), r"(?i)^LINGKUNGAN\s+(.+)$", "Lingkungan $1")),
    )
    for f in ("kk_number", "address", "rt", "rw", "lingkungan"):
        df = df.withColumn(f, F.get(F.filter("hl", lambda x: x[f].isNotNull()), F.lit(0))[f])
    differs = lambda x, f: x[f].isNotNull() & (x[f] != F.col(f))
    say = lambda cond, *parts: F.when(F.coalesce(cond, F.lit(False)), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    told = lambda x: F.filter(F.array(
        say(is_kk(x) & x["kk_number"].isNull() & x["value"].isNotNull(), "Nomor KK tidak terbaca pada baris: ", x["value"]),
        say(differs(x, "kk_number"), "Nomor KK ganda tidak konsisten: ", x["kk_number"], " diabaikan."),
        say(differs(x, "address"), "Label ALAMAT ditemukan lebih dari satu kali." + KEPT),
        say(both(x) & x["rt"].isNull() & x["rw"].isNull(), "Nilai RT/RW ditemukan tetapi formatnya tidak dikenali."),
        say(both(x) & differs(x, "rt"), "Nilai RT berbeda ditemukan pada dokumen." + KEPT), say(both(x) & differs(x, "rw"), "Nilai RW berbeda ditemukan pada dokumen." + KEPT),
        say(~both(x) & differs(x, "rt"), "Nilai RT ganda tidak konsisten." + KEPT), say(~both(x) & differs(x, "rw"), "Nilai RW ganda tidak konsisten." + KEPT),
        say(differs(x, "lingkungan"), "Nilai lingkungan ganda tidak konsisten." + KEPT),
    ), lambda w: w.isNotNull())
    df = df.withColumn("hw", F.flatten(F.transform("hl", told)))
    # Lines without a label that follow the address belong to it.
    at = F.get(F.filter("hl", lambda x: x["address"].isNotNull()), F.lit(0))["i"]
    further = lambda x: x["key"].isNull() & (x["i"] > at) & ~F.contains(x["line"], F.lit(":")) & ~F.exists(x["t"], lambda y: (y["norm"] == "NIK") | _is_id(y))
    more = F.transform(F.filter("hl", further), lambda x: x["line"])
    return df.withColumn("address", F.when(F.col("address").isNotNull(), F.array_join(F.concat(F.array("address"), more), " "))).drop("hl")


def _segments(df: DataFrame) -> DataFrame:
    """``m``, the members as (i, ordinal, t, p: place of the number in t), and ``lost``, warnings of the table as (i, w)."""
    ends = lambda x: x["up"].rlike(f"^(?:{'|'.join(END_MARKERS)})")
    # Without a heading there is no table.
    df = df.withColumn("b", F.slice("lines", F.coalesce(F.col("h") + 2, F.lit(1)), F.when(F.col("h").isNull(), 0).otherwise(F.size("lines"))))
    df = df.withColumn("_e", F.array_position(F.transform("b", ends), True).cast("int"))
    df = df.withColumn("b", F.slice("b", F.lit(1), F.when(F.col("_e") > 0, F.col("_e") - 1).otherwise(F.size("b")))).drop("_e")
    df = _with(
        df, "b", "i line t", kind=lambda x: F.when(F.exists(x["t"], _is_id), "nik").when(F.get(x["t"], F.lit(0))["norm"].rlike(r"^\d{1,2}$"), "num").when(x["up"].isin(NOISE), "noise").otherwise("cont"),
    )
    # Segments begin at lines with a sixteen-digit or a running number; the one before the first has no beginning.
    starts = F.filter(F.transform("b", lambda x, i: F.when(x["kind"].isin("nik", "num"), i + 1)), lambda i: i.isNotNull())
    df = df.withColumn("_s", F.concat(F.array(F.lit(0)), starts))
    lines = lambda s, j: F.slice("b", F.greatest(s, F.lit(1)), F.coalesce(F.get("_s", j + 1), F.size("b") + 1) - F.greatest(s, F.lit(1)))
    df = df.withColumn("_seg", F.transform("_s", lambda s, j: F.struct(F.when(s > 0, F.get("b", s - 1)["kind"]).alias("kind"), F.when(j > 0, F.get("b", F.get("_s", j - 1) - 1)["kind"]).alias("before"), lines(s, j).alias("ls"))))
    member = lambda x: F.coalesce(x["kind"] == "nik", F.lit(False))
    tokens = lambda x: F.flatten(F.transform(F.filter(x["ls"], lambda y: y["kind"] != "noise"), lambda y: y["t"]))
    first = lambda x: F.get(x["ls"], F.lit(0))["i"]
    id_at = lambda x: F.array_position(F.transform(F.get(x["ls"], F.lit(0))["t"], _is_id), True).cast("int")
    df = df.withColumn("m", F.transform(F.filter("_seg", member), lambda x: F.struct(first(x).alias("i"), (first(x) - F.col("h")).alias("ordinal"), tokens(x).alias("t"), id_at(x).alias("p"))))
    lost = lambda x: F.filter(x["ls"], lambda y: y["line"].rlike(r"\d{2,}") | ((y["kind"] == "num") & F.coalesce(x["before"] == "nik", F.lit(False))))
    told = lambda y: F.struct(y["i"].alias("i"), F.concat(F.lit("Baris anggota tidak dapat diuraikan (NIK tidak terbaca): "), y["line"]).alias("w"))
    df = df.withColumn("lost", F.transform(F.flatten(F.transform(F.filter("_seg", lambda x: ~member(x)), lost)), told))
    return df.drop("b", "_s", "_seg", "lines")


def _phrase(df: DataFrame, field: str, done: str) -> DataFrame:
    """Adds ``field`` to the structs of ``ph``: the longest of its phrases (in words) in ``s``, words with a blank before and after each, the earliest of equals; its words are blanked in ``s``."""
    by_len: dict[int, list[str]] = {}
    for p in VOCABULARY[field]:
        by_len.setdefault(len(p.split()), []).append(p)
    one_of = lambda n: f" ({'|'.join(by_len[n])}) "
    df = _with(df, "ph", f"s {done}", f=lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x["s"], one_of(n), 1), F.lit("")) for n in sorted(by_len, reverse=True)]))
    # What stands in its place is no word, so that no phrase goes across it.
    blanked = lambda x: F.when(x["f"].isNull(), x["s"]).otherwise(F.overlay(x["s"], F.lit(" \x00 "), F.instr(x["s"], F.concat(F.lit(" "), x["f"], F.lit(" "))), F.length(x["f"]) + 2))
    return _with(df, "ph", done, s=blanked, **{field: lambda x: F.translate(x["f"], " ", "_") if field in CODED else x["f"]})


def _members(df: DataFrame, newest_year: int) -> DataFrame:
    """Fields of each member of ``m``, ``w`` its warning and ``e`` its errors."""
    word = lambda x, i: F.get(x["a"], i)["norm"]
    is_gender = lambda x: lambda y, i: y["norm"].isin("PEREMPUAN", "LAKI-LAKI", "LAKILAKI") | ((y["norm"] == "LAKI") & F.coalesce(word(x, i + 1) == "LAKI", F.lit(False)))
    shaped = r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"
    lead = lambda x: F.slice(x["t"], F.lit(1), x["p"] - 1)
    skip = lambda x: F.array_position(F.transform(lead(x), lambda y: (F.length(y["norm"]) <= 2) & y["norm"].rlike(r"^\d{1,2}$")), False).cast("int")
    wrong = lambda x: F.get(F.filter(x["a"], lambda y: y["norm"].rlike(shaped)), F.lit(0))["raw"]
    start = lambda x: x["g"] + F.when(word(x, x["g"] - 1) == "LAKI", 2).otherwise(1)
    raw = lambda tokens: F.array_join(F.transform(tokens, lambda y: y["raw"]), " ")

    def birth_place(x: Column) -> Column:
        between = raw(F.slice(x["a"], F.greatest(start(x), F.lit(1)), F.greatest(x["d"] - start(x), F.lit(0))))
        before = raw(F.slice(x["a"], F.lit(1), F.greatest(x["d"] - 1, F.lit(0))))
        loose = E.trim_ws(F.regexp_replace(F.regexp_replace(before, r"(?i)\b(LAKI(-?LAKI)?|PEREMPUAN)\b", ""), r"\s+", " "))
        return F.nullif(F.when((x["d"] > 0) & (x["g"] > 0) & (x["d"] > start(x)), between).when((x["d"] > 1) & (x["g"] == 0), loose), F.lit(""))

    mended = lambda y: F.coalesce(E.label(y["norm"], ALIASES, None), y["norm"])
    begin = lambda x: F.when(x["d"] > 0, x["d"] + 1).when(x["g"] > 0, start(x)).otherwise(1)
    dates = lambda x: F.transform(x["a"], lambda y: y["norm"].between("0", ":") & y["norm"].rlike(shaped) & E.parse_date(y["norm"], newest_year).isNotNull())
    df = _with(
        df, "m", "i ordinal", nik=lambda x: F.get(x["t"], x["p"] - 1)["norm"], nama=lambda x: F.when(skip(x) > 0, raw(F.slice(lead(x), skip(x), x["p"]))),
        a=lambda x: F.slice(x["t"], x["p"] + 1, F.size(x["t"])),
    )
    df = _with(
        df, "m", "i ordinal nik nama a", g=lambda x: F.array_position(F.transform(x["a"], is_gender(x)), True).cast("int"), d=lambda x: F.array_position(dates(x), True).cast("int"),
    )
    df = _with(
        df, "m", "i ordinal nik nama", gender=lambda x: F.when(x["g"] > 0, F.when(word(x, x["g"] - 1) == "PEREMPUAN", "PEREMPUAN").otherwise("LAKI_LAKI")),
        birth_date=lambda x: E.parse_date(word(x, x["d"] - 1), newest_year).cast("string"), wrong=lambda x: F.when(x["d"] == 0, wrong(x)), birth_place=birth_place,
        s=lambda x: F.concat(F.lit(" "), F.array_join(F.transform(F.slice(x["a"], begin(x), F.size(x["a"])), mended), " "), F.lit(" ")),
    )
    # The words that phrases are looked for in have an array of their own.
    df, done = df.withColumn("ph", F.transform("m", lambda x: F.struct(x["s"].alias("s")))), ""
    for field in VOCABULARY:
        df = _phrase(df, field, done)
        done = f"{done} {field}".strip()
    # Null unless a number is there twice, so that most cards are done with one look.
    df = df.withColumn("_niks", _bound(F.transform("m", lambda x: x["nik"]), lambda xs: F.when(F.size(F.array_distinct(xs)) < F.size(xs), xs)))
    own = ["i", "ordinal", "nik", "nama", "gender", "birth_date", "birth_place", "wrong"]
    # What a lambda reads once is moved into it and made anew for each element; these are read several times.
    of = lambda i: F.get("ph", i)
    again = lambda x, i: F.when(F.col("_niks").isNull(), F.lit(False)).otherwise(F.exists(F.slice("_niks", F.lit(1), i), lambda n: n == x["nik"])).alias("again")
    df = df.withColumn("m", F.transform("m", lambda x, i: F.struct(*[x[f].alias(f) for f in own], *[of(i)[f].alias(f) for f in VOCABULARY], again(x, i)))).drop("_niks", "ph")
    missing = lambda x: F.filter(F.array(*[F.when(x[f].isNull(), text) for f, text in (("gender", "jenis kelamin"), ("birth_date", "tanggal lahir"), ("religion", "agama"), ("family_relation", "hubungan keluarga"))]), lambda y: y.isNotNull())
    place = lambda x: x["ordinal"].cast("string")
    return _with(
        df, "m", " ".join([*own, *VOCABULARY, "again"]), e=lambda x: F.when(~x["again"] & x["wrong"].isNotNull(), F.concat(F.lit("Tanggal lahir tidak valid pada anggota ke-"), place(x), F.lit(": "), x["wrong"])),
        w=lambda x: F.when(x["again"], F.concat(F.lit("NIK duplikat diabaikan: "), x["nik"])).when(F.size(missing(x)) > 0, F.concat(F.lit("Anggota ke-"), place(x), F.lit(" belum terbaca lengkap: "), F.array_join(missing(x), ", "), F.lit("."))),
    )


MEMBER = ["nama", "nik", "gender", "birth_place", "birth_date", "religion", "education", "occupation", "marital_status", "family_relation"]


def parse_households(docs: DataFrame, newest_year: int) -> DataFrame:
    """One row per row of ``docs`` (id, raw_text, confidence) with the household, its ``members``, ``warnings`` and ``validation_errors``."""
    df = _members(_segments(_header(_lines(docs.select("id", "raw_text", "confidence")))), newest_year)
    low, blank = F.col("confidence") < THRESHOLD, F.col("blank")
    df = df.withColumn("kept", F.filter("m", lambda x: ~x["again"]))
    heads, some = F.size(F.filter("kept", lambda x: x["family_relation"] == "KEPALA_KELUARGA")), F.size("kept") > 0
    empty = F.expr("cast(array() as array<string>)")
    when = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(text))).otherwise(empty)
    of = lambda c, f: F.transform(F.array_sort(F.transform(F.filter(c, lambda x: x[f].isNotNull()), lambda x: F.struct(x["i"].alias("i"), x[f].alias("w")))), lambda x: x["w"])
    told = F.transform(F.array_sort(F.concat("lost", F.transform(F.filter("m", lambda x: x["w"].isNotNull()), lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))), lambda x: x["w"])
    warnings = F.concat(
        when(F.col("confidence") < UNREADABLE, "Gambar tidak terbaca dengan baik (confidence sangat rendah)."), when(blank, "OCR tidak menghasilkan teks (gambar kosong atau tidak terbaca)."), F.col("hw"),
        when(~blank & F.col("h").isNull(), "Baris tabel anggota tidak terdeteksi."), told, when(some & (heads == 0), "Kepala Keluarga belum terbaca dari hasil OCR."),
    )
    errors = F.concat(
        when(blank, "OCR tidak menemukan NIK."), of("m", "e"), when(~blank & F.col("kk_number").isNull(), "Nomor KK tidak ditemukan atau tidak terbaca."),
        when(~blank & ~some, "OCR tidak menemukan NIK anggota keluarga."), when(some & (heads > 1), "OCR menemukan lebih dari satu anggota dengan hubungan Kepala Keluarga. Periksa kembali sebelum menyimpan."),
    )
    members = F.transform("kept", lambda x: F.struct(*[x[f].alias(f) for f in MEMBER], F.col("confidence").alias("confidence"), low.alias("low_confidence")))
    # A column that counts as undetermined keeps filters above this projection: pushed below, they would carry the whole chain of expressions with them.
    members = F.when(F.monotonically_increasing_id() >= 0, members)
    return df.select("id", "confidence", low.alias("low_confidence"), "kk_number", "address", "rt", "rw", "lingkungan", members.alias("members"), warnings.alias("warnings"), errors.alias("validation_errors"))
