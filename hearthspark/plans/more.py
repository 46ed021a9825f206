"""Further queries of the catalogue: exports, review before saving, applied changes, checks of archives, and searches with their own plans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from hearthspark.functions import expr as E
from hearthspark.operators import filters, household_text, membership, quality, reports, review, views
from hearthspark.plans.catalog import AS_OF, STATUS, born, household_texts, query
from hearthspark.sources import exports
from hearthspark.sources.tables import table

c = F.col
ON = date(2024, 6, 1)


# Counts, filters, searches


@query("count_by_gender", sql="select e.v gender, count(o.o_orderkey) total from (values ('1-URGENT'),('2-HIGH'),('3-MEDIUM'),('0-NONE')) e(v) left join orders o on o.o_orderpriority=e.v and o.o_orderstatus='O' group by e.v")
def count_by_gender(spark, d):
    return reports.count_by_domain(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "0-NONE"], "gender")


@query("count_by_occupation", sql="select p_type name, count(*) active_count from lineitem join part on l_partkey=p_partkey where l_linestatus='O' group by p_type order by active_count desc, name")
def count_by_occupation(spark, d):
    # Counted by key before the names are met.
    n = table(spark, d, "lineitem").filter("l_linestatus = 'O'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return n.join(p, c("l_partkey") == c("p_partkey")).groupBy(c("p_type").alias("name")).agg(F.sum("n").alias("active_count")).orderBy(F.desc("active_count"), "name")


@query("count_by_education", sql="select lang name, count(*) active_count from documents d join labels l on l.doc_id=d.doc_id where quality=1 group by lang order by active_count desc, name")
def count_by_education(spark, d):
    good = filters.keep_with(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").filter("quality = 1"), "doc_id", "doc_id")
    return reports.count_by_lookup(good, c("lang"))


@query("sort_by_member_count", sql="select c_custkey, n from (select c.c_custkey, count(o.o_orderkey) n from customer c left join orders o on o.o_custkey=c.c_custkey group by c.c_custkey) z order by n desc, c_custkey limit 25 offset 25")
def sort_by_member_count(spark, d):
    counted = views.child_count(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")
    return filters.offset_page(counted.select("c_custkey", "n"), [F.desc("n"), "c_custkey"], 2)


@query("global_search", sql="select 'kk' kind, c_custkey id from customer where c_name ilike '%0012%' union all select 'penduduk', o_orderkey from orders where cast(o_orderkey as varchar) ilike '%0012%' or o_custkey in (select c_custkey from customer where c_name ilike '%0012%')")
def global_search(spark, d):
    """Households and residents with the text, the residents by their household's too."""
    homes = table(spark, d, "customer").filter(E.contains_any([c("c_name")], "0012"))
    people = filters.flag_with(table(spark, d, "orders").select("o_orderkey", "o_custkey"), homes, "o_custkey", "c_custkey", "f")
    people = people.filter(E.contains_any([c("o_orderkey")], "0012") | c("f"))
    return homes.select(F.lit("kk").alias("kind"), c("c_custkey").alias("id")).unionByName(people.select(F.lit("penduduk").alias("kind"), c("o_orderkey").alias("id")))


def resident_columns(spark, d):
    """Orders and what they hang on, under the registry's names."""
    o, h, n, r = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    rows = born(o).join(h, c("o_custkey") == c("c_custkey"), "left").join(n, c("c_nationkey") == c("n_nationkey"), "left").join(r, c("n_regionkey") == c("r_regionkey"), "left")
    status = F.when(c("o_orderstatus") == "O", "ACTIVE").when(c("o_orderstatus") == "P", "PINDAH").otherwise("MENINGGAL")
    return rows.select(
        E.pad_left(c("o_orderkey").cast("string"), 16).alias("nik"), F.concat(F.lit("R "), c("o_orderkey").cast("string")).alias("full_name"), c("c_name").alias("kk_number"),
        F.when(c("o_orderkey") % 2 == 0, "LAKI_LAKI").otherwise("PEREMPUAN").alias("gender"), c("r_name").alias("birth_place"), "birth_date", c("n_nationkey").cast("string").alias("rt_number"),
        F.lit("lingkungan").alias("area_type"), F.lit(None).cast("string").alias("area_code"), c("r_name").alias("area_name"), status.alias("resident_status"), c("c_mktsegment").alias("religion"),
        c("o_orderpriority").alias("education"), F.lit(None).cast("string").alias("occupation"), c("n_nationkey").alias("rt_id"), c("n_regionkey").alias("area_unit_id"), c("o_custkey").alias("religion_id"),
    )


@query("export_filter", sql="select lpad(cast(o_orderkey as varchar),16,'0') nik from orders join customer on o_custkey=c_custkey where c_nationkey=5 and o_orderkey%2=0 and o_orderstatus='O' and cast(o_orderdate as date)<=date '2010-03-01' - interval 12 year and cast(o_orderdate as date)>date '2010-03-01' - interval 13 year")
def export_filter(spark, d):
    """By RT number, gender, status and an exact age, which wins over the range beside it."""
    spec = filters.FilterSpec(rt_number="5", gender="LAKI_LAKI", resident_status="ACTIVE", age=12, age_min=0, age_max=3)
    return filters.apply_filters(resident_columns(spark, d), spec, AS_OF).select("nik")


@query("age_custom", sql="select o_orderkey from orders where cast(o_orderdate as date) <= date '2010-03-01' - interval 15 year")
def age_custom(spark, d):
    """A range with one open side."""
    return filters.apply_filters(born(table(spark, d, "orders")), filters.FilterSpec(age_min=15), AS_OF).select("o_orderkey")


@query("blank_filter", sql="select o_orderkey from orders")
def blank_filter(spark, d):
    return filters.apply_filters(born(table(spark, d, "orders")), filters.from_params({"query": "  ", "nik": "", "gender": "", "page": 3}), AS_OF).select("o_orderkey")


@query("search_words", sql="select lpad(cast(o_orderkey as varchar),16,'0') nik from orders o join customer on o_custkey=c_custkey join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey where (lpad(cast(o_orderkey as varchar),16,'0') ilike '%12%' or c_name ilike '%12%' or r_name ilike '%12%') and (lpad(cast(o_orderkey as varchar),16,'0') ilike '%asia%' or c_name ilike '%asia%' or r_name ilike '%asia%')")
def search_words(spark, d):
    return filters.search_words(resident_columns(spark, d), "12 asia", ["nik", "kk_number", "area_name"]).select("nik")


@query("search_backslash", sql="select count(*) n from pages where contains(url, chr(92))")
def search_backslash(spark, d):
    return table(spark, d, "pages").filter(E.contains_any([c("url")], "\\")).agg(F.count(F.lit(1)).alias("n"))


# Exports, detail records, archives


@query("export_columns", sql="select lpad(cast(o_orderkey as varchar),16,'0') \"NIK\", 'R '||o_orderkey \"Nama Lengkap\", coalesce(c_name,'-') \"Nomor KK\", case when o_orderkey%2=0 then 'Laki-laki' else 'Perempuan' end \"Jenis Kelamin\", coalesce(r_name,'-') \"Tempat Lahir\", strftime(o_orderdate,'%d-%m-%Y') \"Tanggal Lahir\", cast(year(date '2010-03-01')-year(o_orderdate)-case when month(o_orderdate)*100+day(o_orderdate) > 301 then 1 else 0 end as varchar) \"Usia (th)\", coalesce(cast(n_nationkey as varchar),'-') \"RT\", coalesce(r_name,'-') \"RW\", case o_orderstatus when 'O' then 'Aktif' when 'P' then 'Pindah' else 'Meninggal' end \"Status\", coalesce(c_mktsegment,'-') \"Agama\", o_orderpriority \"Pendidikan\", '-' \"Pekerjaan\" from orders left join customer on o_custkey=c_custkey left join nation on n_nationkey=c_nationkey left join region on r_regionkey=n_regionkey")
def export_columns(spark, d):
    """All thirteen columns of the export."""
    return exports.export_rows(resident_columns(spark, d), AS_OF)


@query("household_detail", sql="select c_custkey, cast(to_json({'kk':c_name,'status':coalesce(n_name,'-')}) as varchar) kk, coalesce(m.members,'') members from customer left join nation on n_nationkey=c_nationkey left join (select o_custkey, string_agg(lpad(cast(o_orderkey as varchar),16,'0')||':'||case o_orderstatus when 'O' then 'Aktif' when 'P' then 'Pindah' else 'Meninggal' end, ',' order by o_orderkey) members from orders group by o_custkey) m on m.o_custkey=c_custkey")
def household_detail(spark, d):
    """A household's own record with its members nested, each with its labels."""
    homes = table(spark, d, "customer").join(table(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", F.to_json(F.struct(c("c_name").alias("kk"), F.coalesce("n_name", F.lit("-")).alias("status"))).alias("kk"))
    people = table(spark, d, "orders").select(c("o_custkey").alias("k"), "o_orderkey", E.pad_left(c("o_orderkey").cast("string"), 16).alias("nik"), E.label(c("o_orderstatus"), STATUS).alias("st"))
    nested = views.nested(homes, people, "c_custkey", "k", ["o_orderkey", "nik", "st"])
    members = F.transform(F.coalesce("members", F.expr("cast(array() as array<struct<o_orderkey:bigint,nik:string,st:string>>)")), lambda x: F.concat_ws(":", x["nik"], x["st"]))
    return nested.select("c_custkey", "kk", F.array_join(members, ",").alias("members"))


_SUM = "cast(sum(cast('0x' || substr(md5({}), 1, 14) as bigint)) as varchar)"


@query("snapshot_checksum", sql=f"select 'documents' tbl, count(*) n, {_SUM.format('doc_id || chr(31) || source || chr(31) || text')} checksum from documents union all select 'customer', count(*), {_SUM.format('c_custkey || chr(31) || c_name || chr(31) || c_mktsegment')} from customer")
def snapshot_checksum(spark, d):
    """Row counts and order-free hashes: the sum of the rows' hashes."""
    kinds = {"documents": ["doc_id", "source", "text"], "customer": ["c_custkey", "c_name", "c_mktsegment"]}
    hashed = lambda cols: F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[c(x).cast("string") for x in cols])), 1, 14), 16, 10).cast("decimal(38,0)")
    parts = [table(spark, d, t).agg(F.lit(t).alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum(hashed(cols)).cast("string").alias("checksum")) for t, cols in kinds.items()]
    return parts[0].unionByName(parts[1])


@query("archive_summary", sql="select count(*) file_count, cast(sum(length(html)) as bigint) total_size, count(*)<=10000 and sum(length(html))<=2147483648 and count(case when url like '/%' or instr(url,chr(92))>0 or instr(url,'..')>0 or length(html)>262144000 then 1 end)=0 and count(distinct case when page_id in (0,1) then page_id end)=2 ok from (select page_id, case when page_id<2 then 'required-'||page_id else url end url, html from pages) z")
def archive_summary(spark, d):
    name = F.when(c("page_id") < 2, F.concat(F.lit("required-"), c("page_id").cast("string"))).otherwise(c("url"))
    entries = table(spark, d, "pages").select(name.alias("name"), F.length("html").cast("long").alias("size"))
    return exports.archive_summary(entries, ["required-0", "required-1"])


@query("upload_validate", sql="select page_id, cast((page_id%4<>0)::int + (page_id%3=2)::int + (length(html)>5242880)::int as int) n_errors from pages")
def upload_validate(spark, d):
    name = F.when(c("page_id") % 4 == 0, "kk.JPG").otherwise("kk.pdf")
    mime = F.when(c("page_id") % 3 == 0, "image/jpeg").when(c("page_id") % 3 == 1, "image/png")
    return table(spark, d, "pages").select("page_id", F.size(exports.upload_errors(name, mime, F.length("html"))).alias("n_errors"))


# Texts


@query("tsv_words", sql="select conv_id, string_agg(line, chr(10) order by turn) raw_text, round(sum(conf)/sum(n),2) confidence, cast(sum(n) as int) word_count from (select conv_id, turn, string_agg(w, ' ' order by i) line, cast(sum(50+(i*7+turn)%50) as double) conf, count(*) n from (select conv_id, turn, unnest(string_split(text,' ')) w, unnest(range(1,len(string_split(text,' '))+1)) i from conversations) x where trim(regexp_replace(w,'\\s','','g'))<>'' group by conv_id, turn) y group by conv_id")
def tsv_words(spark, d):
    """An engine's word table to text: words from the conversations, a turn a line."""
    words = table(spark, d, "conversations").select("conv_id", c("turn").alias("line_num"), F.posexplode(F.split("text", " ", -1)).alias("word_num", "text"))
    conf = (50 + ((c("word_num") + 1) * 7 + c("line_num")) % 50).cast("double")
    rows = words.select("conv_id", F.lit(5).alias("level"), F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), "line_num", "word_num", conf.alias("conf"), "text")
    return household_text.tsv_text(rows.filter(F.regexp_replace("text", r"\s", "") != ""), "conv_id")


@query("merge_digit_runs", sql="select o_orderkey, case when o_orderkey%3=0 then lpad(cast(o_orderkey as varchar),16,'0') else '12 ' || lpad(cast(o_orderkey as varchar),16,'0') end k from orders")
def merge_digit_runs(spark, d):
    nik = E.pad_left(c("o_orderkey").cast("string"), 16)
    spread = F.concat_ws(" ", *[F.substring(nik, i, 4) for i in (1, 5, 9, 13)])
    line = F.when(c("o_orderkey") % 3 == 0, spread).otherwise(F.concat(F.lit("12 "), nik))
    return table(spark, d, "orders").select("o_orderkey", line.alias("line")).select("o_orderkey", F.array_join(F.transform(household_text.line_tokens(c("line")), lambda x: x["norm"]), " ").alias("k"))


@query("vocab_match", sql="select o_custkey id, list_extract(['ISLAM','KATOLIK','HINDU'], cast(o_orderkey%3+1 as int)) religion, count(*) n from orders group by 1,2")
def vocab_match(spark, d):
    """Members by the religion that the vocabulary finds in their card's line."""
    rows = household_text.parse_households(household_texts(spark, d), 2100).select("id", F.explode("members").alias("m"))
    return rows.groupBy("id", c("m.religion").alias("religion")).agg(F.count(F.lit(1)).alias("n"))


@query("member_ordinals", sql="select o_custkey id, cast(count(*) as int) members, lpad(cast(min(o_orderkey) as varchar),16,'0') first_nik from orders group by o_custkey")
def member_ordinals(spark, d):
    return household_text.parse_households(household_texts(spark, d), 2100).select("id", F.size("members").alias("members"), c("members")[0]["nik"].alias("first_nik"))


@query("first_messages", sql="select conv_id, string_agg(role||':'||length(text), ',' order by turn) m from (select *, row_number() over (partition by conv_id order by turn) rn from conversations) z where rn<=3 group by conv_id")
def first_messages(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("t"))
    return review.first_messages(rows, "conv_id", "turn", "t", 3).select("conv_id", F.array_join("messages", ",").alias("m"))


@query("unique_paths", sql="select page_id, array_to_string(list_sort(list_distinct(string_split(url,'/'))),'|') p from pages where url is not null")
def unique_paths(spark, d):
    return table(spark, d, "pages").filter("url is not null").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.split("url", "/", -1))), "|").alias("p"))


# Review before saving


def _members(spark, d):
    """Members with faults in their fields, by their number."""
    k = c("o_orderkey")
    nth = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    member = F.struct(
        F.when(k % 7 == 0, "").when(k % 7 == 1, "12x").otherwise(E.pad_left(k.cast("string"), 16)).alias("nik"), nth("A", " ", "B").alias("nama"), nth("LAKI_LAKI", "X", "PEREMPUAN", "").alias("gender"), F.lit("KOTA").alias("birth_place"),
        nth("2001-02-28", "2001-02-30", "1/2/95", "31-12-1899", "soon", "").alias("birth_date"), nth("ISLAM", "").alias("religion"), F.lit("SD").alias("education"), F.lit("PETANI").alias("occupation"),
        nth("KAWIN", "JANDA", "CERAI_MATI").alias("marital_status"), nth("ANAK", "ANAK", "PAMAN", "").alias("family_relation"),
    )
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", member.alias("m"))


_FAULTS = {
    "nik": "case when k%7=0 then 'NIK anggota ke-'||n||' wajib diisi' when k%7=1 then 'NIK anggota ke-'||n||' harus 16 digit angka' end", "nama": "case when k%3=1 then 'Nama anggota ke-'||n||' wajib diisi' end",
    "gender": "case when k%4=1 then 'Jenis kelamin anggota ke-'||n||' tidak dikenal' when k%4=3 then 'Jenis kelamin anggota ke-'||n||' wajib diisi' end",
    "birth_date": "case when k%6 in (1,3,4) then 'Tanggal lahir anggota ke-'||n||' tidak valid' when k%6=2 then 'Tanggal lahir anggota ke-'||n||' tidak valid' when k%6=5 then 'Tanggal lahir anggota ke-'||n||' wajib diisi' end",
    "religion": "case when k%2=1 then 'Agama anggota ke-'||n||' wajib diisi' end", "marital_status": "case when k%3=1 then 'Status perkawinan anggota ke-'||n||' tidak dikenal' end",
    "family_relation": "case when k%4=2 then 'Status hubungan keluarga anggota ke-'||n||' tidak dikenal' when k%4=3 then 'Status hubungan keluarga anggota ke-'||n||' wajib diisi' end",
}


@query(
    "ocr_review",
    sql="with m as (select o_custkey id, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) n from orders) select * from ("
    + " union all ".join(f"select id, 'members.'||(n-1)||'.{f}' as path, {said} as message from m" for f, said in _FAULTS.items())
    + ") z where message is not null union all select c_custkey, 'kk_number', 'Nomor KK harus 16 digit angka' from customer where c_custkey%5=0 union all select c_custkey, 'members', 'Minimal satu anggota keluarga wajib diisi' from customer where c_custkey not in (select o_custkey from orders)",
)
def ocr_review(spark, d):
    """Every fault of every household, in the newest year 2026. Years of two digits are of this century: 1/2/95 is not there yet."""
    lists = _members(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "m"))).alias("l"))
    homes = table(spark, d, "customer").join(lists, c("c_custkey") == c("o_custkey"), "left")
    number = F.when(c("c_custkey") % 5 == 0, "123").otherwise(E.pad_left(c("c_custkey").cast("string"), 16))
    kind = lists.schema["l"].dataType.elementType["m"].dataType.simpleString()
    rows = homes.select(c("c_custkey").alias("id"), number.alias("kk_number"), F.lit("JL. 1").alias("address"), F.coalesce(F.transform("l", lambda x: x["m"]), F.expr(f"cast(array() as array<{kind}>)")).alias("members"))
    return review.review_errors(rows, 2026).select("id", F.explode_outer("errors").alias("e")).filter("e is not null").select("id", "e.path", "e.message")


@query("correction_overlay", sql="with b as (select o_custkey id, cast(row_number() over (partition by o_custkey order by o_orderkey)-1 as bigint) idx, 'N'||o_orderkey nama, o_orderpriority gender from orders), k as (select user_id id, event_id%3 idx, arg_max('E'||event_id, event_id) filter (event_type='view') nama, arg_max(event_type, event_id) filter (event_type in ('click')) gender from events where event_type in ('view','click') group by 1,2) select coalesce(b.id,k.id) id, coalesce(b.idx,k.idx) idx, coalesce(k.nama,b.nama) nama, coalesce(k.gender,b.gender) gender from b full join k on k.id=b.id and k.idx=b.idx")
def correction_overlay(spark, d):
    """Corrections by household, member index and field; those of unknown fields do nothing."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    base = lists.select(c("o_custkey").alias("id"), F.posexplode("l").alias("idx", "m")).select("id", c("idx").cast("long").alias("idx"), F.concat(F.lit("N"), c("m.o_orderkey").cast("string")).alias("nama"), c("m.o_orderpriority").alias("gender"))
    field = F.when(c("event_type") == "view", "nama").when(c("event_type") == "click", "gender").otherwise("unknown")
    value = F.when(c("event_type") == "view", F.concat(F.lit("E"), c("event_id").cast("string"))).otherwise(c("event_type"))
    fixes = table(spark, d, "events").select(c("user_id").alias("id"), (c("event_id") % 3).alias("idx"), field.alias("field"), value.alias("value"), c("event_id").alias("at"))
    return review.overlay_members(base, fixes, ["nama", "gender"])


@query("member_save_failfast", sql="with m as (select o_custkey id, row_number() over (partition by o_custkey order by o_orderkey) idx, case when o_totalprice<20000 then 'NIK harus 16 digit.' when o_orderpriority not in ('1-URGENT','2-HIGH','3-MEDIUM') then 'religion: '||o_orderpriority end s from orders) select id, cast(idx as int) idx, s message from (select *, row_number() over (partition by id order by idx) rn from m where s is not null) z where rn=1")
def member_save_failfast(spark, d):
    """The first member of each household that can't be saved, and why: a rule, else an unknown lookup name."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderpriority"))).alias("l"))
    rows = lists.select(c("o_custkey").alias("id"), F.posexplode("l").alias("i", "m")).select("id", (c("i") + 1).alias("idx"), c("m.o_totalprice").alias("price"), c("m.o_orderpriority").alias("religion"))
    return review.first_failure(rows, {"religion": reports.domain(spark, ["1-urgent ", "2-High", " 3-MEDIUM"], "name")}, {"NIK harus 16 digit.": c("price") < 20000})


@query("resident_validation", sql="select o_orderkey, cast((o_orderkey%5=0)::int + (o_orderkey%3=0)::int + (o_orderdate>timestamp '2000-01-01')::int + (o_orderstatus='P' and o_orderkey%2=0)::int + (o_orderstatus<>'P' and o_orderkey%2=1)::int + (o_orderstatus='F')::int as int) n from orders")
def resident_validation(spark, d):
    k = c("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "12").otherwise(E.pad_left(k.cast("string"), 16)).alias("nik"), F.when(k % 3 == 0, " ").otherwise("A").alias("full_name"), F.lit("LAKI_LAKI").alias("gender"),
        F.lit("KAWIN").alias("marital_status"), F.lit("ANAK").alias("family_relation"), F.to_date(F.when(c("o_orderdate") > F.lit("2000-01-01").cast("timestamp"), F.lit("2000-01-02")).otherwise("1990-01-01")).alias("birth_date"),
        F.when(k % 2 == 1, F.lit(date(1995, 1, 1))).alias("moved_at"), F.lit(None).cast("date").alias("deceased_at"), F.when(c("o_orderstatus") == "O", "ACTIVE").when(c("o_orderstatus") == "P", "PINDAH").otherwise("MENINGGAL").alias("resident_status"),
    )
    return rows.select("o_orderkey", F.size(quality.resident_errors(date(2000, 1, 1))).alias("n"))


@query("household_validation", sql="select c_custkey, cast((c_custkey%4=0)::int + (c_custkey%6=0)::int + (c_custkey%3=1)::int as int) n from customer")
def household_validation(spark, d):
    k = c("c_custkey")
    rows = table(spark, d, "customer").select(
        k, F.when(k % 4 == 0, "x").otherwise(E.pad_left(k.cast("string"), 16)).alias("kk_number"), F.when(k % 6 == 0, "").otherwise("JL. 1").alias("address"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "123").otherwise("90111").alias("postal_code"),
    )
    return rows.select("c_custkey", F.size(quality.household_errors()).alias("n"))


# Applied changes


@query("history_applied", sql="with h as (select event_id id, event_id%25 kk_id, user_id penduduk_id, event_type family_relation, cast(ts as date) effective_date, cast(lead(ts) over w as date) end_date, case when lead(ts) over w is null then 'AKTIF' else 'KELUAR' end status from events window w as (partition by user_id order by ts, event_id)), j as (select h.*, c_custkey p, c_nationkey kk, coalesce(status='AKTIF' and kk_id=c_nationkey, false) here from h left join customer on c_custkey=penduduk_id and c_acctbal>0), k as (select *, here and row_number() over (partition by penduduk_id order by case when here then 0 else 1 end, id)=1 keep from j) select id, kk_id, penduduk_id, case when keep then 'ANAK' else family_relation end family_relation, case when p is not null and status='AKTIF' and not keep then 'KELUAR' else status end status, effective_date, case when p is not null and status='AKTIF' and not keep then date '2024-06-01' when keep then null else end_date end end_date from k union all select null, c_nationkey, c_custkey, 'ANAK', 'AKTIF', date '2024-06-01', null from customer where c_acctbal>0 and c_custkey not in (select penduduk_id from k where keep)")
def history_applied(spark, d):
    """Memberships after a day's moves: other households' closed, the same household's kept open, new ones opened."""
    e = table(spark, d, "events")
    rows = membership.history(e.select(c("event_id").alias("id"), (c("event_id") % 25).alias("kk_id"), c("user_id").alias("penduduk_id"), c("event_type").alias("family_relation"), "ts"), "penduduk_id", ["ts", "id"], "ts").drop("ts")
    moves = table(spark, d, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("penduduk_id"), c("c_nationkey").cast("long").alias("kk_id"), F.lit("ANAK").alias("family_relation"))
    return membership.apply_moves(rows, moves, ON)


_UPSERT = "select coalesce(o.o_orderkey,i.k) nik, case when {takes} then i.kk else o.o_custkey end kk_id, case when {takes} then 'ACTIVE' else {status} end resident_status, case when {takes} and ({clear}) then null else case when o_orderstatus='P' then cast(o_orderdate as date) end end moved_at from (select * from orders where o_totalprice>100000) o full join (select l_orderkey k, min(l_partkey) kk from lineitem group by l_orderkey) i on i.k=o.o_orderkey"
_STATUS = "case o_orderstatus when 'O' then 'ACTIVE' when 'P' then 'PINDAH' else 'MENINGGAL' end"


def _residents(spark, d):
    status = F.when(c("o_orderstatus") == "O", "ACTIVE").when(c("o_orderstatus") == "P", "PINDAH").otherwise("MENINGGAL")
    return table(spark, d, "orders").filter("o_totalprice > 100000").select(c("o_orderkey").alias("nik"), c("o_custkey").alias("kk_id"), status.alias("resident_status"), F.when(c("o_orderstatus") == "P", F.to_date("o_orderdate")).alias("moved_at"))


def _incoming(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("nik")).agg(F.min("l_partkey").alias("kk_id"))


@query("upsert_applied", sql=_UPSERT.format(takes="i.k is not null and (o.o_orderkey is null or o_orderstatus='O')", status=_STATUS, clear="o.o_orderkey is null"))
def upsert_applied(spark, d):
    return membership.apply_upsert(_residents(spark, d), _incoming(spark, d))


@query("bulk_create_applied", sql=_UPSERT.format(takes="i.k is not null", status=_STATUS, clear="true"))
def bulk_create_applied(spark, d):
    return membership.apply_upsert(_residents(spark, d), _incoming(spark, d), reactivate=True)


@query("nik_taken", sql="select c_custkey id, c_custkey+c_nationkey nik from customer where exists(select 1 from orders o where o.o_orderkey=c_custkey+c_nationkey and o.o_custkey<>c_custkey)")
def nik_taken(spark, d):
    edits = table(spark, d, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") + c("c_nationkey")).alias("nik"))
    return membership.taken_niks(edits, table(spark, d, "orders").select(c("o_custkey").alias("id"), c("o_orderkey").alias("nik")))


@query("import_rows", sql="select o_orderkey nik, o_custkey kk_id from orders where o_custkey not in (select o_custkey from orders where o_totalprice<5000)")
def import_rows(spark, d):
    return membership.import_rows(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", c("o_totalprice") < 5000).select(c("o_orderkey").alias("nik"), c("o_custkey").alias("kk_id"))


@query("duplicate_in_import", sql="with b as (select *, row_number() over (partition by batch_id, nik order by idx)=2 again from (select l_orderkey batch_id, l_linenumber*1000000000000000+l_partkey*1000000+l_suppkey idx, l_suppkey nik from lineitem) z) select batch_id, coalesce(arg_min(nik, idx) filter (again), arg_min(nik, idx) filter (nik in (select s_suppkey from supplier where s_nationkey=3))) duplicate_nik from b group by batch_id having count(*) filter (again or nik in (select s_suppkey from supplier where s_nationkey=3))>0")
def duplicate_in_import(spark, d):
    """The first number that repeats within a batch, else the first that is known already."""
    batch = table(spark, d, "lineitem").select(c("l_orderkey").alias("batch_id"), (c("l_linenumber").cast("long") * 10**15 + c("l_partkey") * 1_000_000 + c("l_suppkey")).alias("idx"), c("l_suppkey").alias("nik"))
    return membership.duplicate_in_import(batch, table(spark, d, "supplier").filter("s_nationkey = 3").select(c("s_suppkey").alias("nik")))


@query("replace_active", sql="select event_id id, user_id, row_number() over (partition by user_id order by event_id desc)=1 and user_id not in (select c_custkey from customer where c_acctbal<0) is_active from events union all select -c_custkey, c_custkey, true from customer where c_acctbal<0")
def replace_active(spark, d):
    """New versions for some keys: what was active is archived."""
    old = views.active_version(table(spark, d, "events").select(c("event_id").alias("id"), "user_id"), ["user_id"], "id")
    fresh = table(spark, d, "customer").filter("c_acctbal < 0").select((-c("c_custkey")).alias("id"), c("c_custkey").alias("user_id"))
    return membership.replace_active(old, fresh, ["user_id"])
