"""Raw text records of delimited exports: permissive reading, reasons for failure, drifting layouts.

``split_records`` reads every record permissively under its file's explicit header, keeps the raw text, and
classifies each field value. ``failing_records`` and ``load_records`` reclassify the rest by quoting, count and cast
checks. ``layout_changes`` fuses the parallel schemas of the files of a folder: each field keeps the counts of every
alternative type, a field's type is the alternative that nearly all values take, and appearing alternatives,
renames, additions and removals are reported. ``unified_table`` loads all files into one table with a typed column
per field; a field whose files differ in type becomes typed branches beside its canonical text.

Nulls: a null raw text is an empty record (one empty field). Records of a file without header fail as
``too_many_fields``, since nothing is declared for them. Repeated header rows of one file: the latest counts. A name
that a header repeats gets its number, as in ``Name (2)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import strip
from corpusloom.session import cut_lineage, over_cores, small_side, written

FILE = ["_source_folder", "_source_file"]
#: Share of filled values that makes "nearly all".
NEARLY_ALL = 0.9
#: Classes of a single value.
BLANK, WHOLE, DECIMAL, TRUTH, YMD, DMY, NO_DAY, TEXT = "b", "w", "f", "t", "y", "d", "z", "x"
#: Type of a field -> classes that load under it. Text takes everything.
LOADS = {WHOLE: "bw", DECIMAL: "bwf", TRUTH: "bt", YMD: "byd", DMY: "byd"}
#: Buckets for the words of text fields when contents are compared.
WORD_BUCKETS = 512


def _escaped(delim: str) -> str:
    return "\\" + delim if not delim.isalnum() else delim


def _quoted_ok(delim: str) -> str:
    """Whole record: each field that begins with a quote closes right before a separator or the end."""
    d = _escaped(delim)
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"|(?!")[^{d}]*+)'
    return rf"\A{field}(?:{d}{field})*+\z"


def _one_field(delim: str) -> str:
    """A separator and the field behind it, for records that passed ``_quoted_ok``."""
    d = _escaped(delim)
    return rf'{d}("[^"]*+(?:""[^"]*+)*+"|[^{d}]*+)'


def _per_delimiter(delims: list[str], make, kind: str = "array<string>") -> Column:
    """``make(delim)`` of the row's own delimiter, with literal patterns so that each is compiled once."""
    out = F.lit(None).cast(kind)
    for d in delims:
        out = F.when(F.col("delim") == d, make(d)).otherwise(out)
    return out


def _fields(delims: list[str], body: Column) -> Column:
    raw = _per_delimiter(delims, lambda d: F.when(F.regexp_like(body, F.lit(_quoted_ok(d))), F.regexp_extract_all(F.concat(F.lit(d), body), F.lit(_one_field(d)), 1)))
    return raw


def _unquoted(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


def headers(export_files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Per file its delimiter, cleaned field names and predecessor's names; and the distinct delimiters.

    Works on file metadata only: one row per file, worked out once.
    """
    last = export_files.groupBy(*FILE).agg(F.max(F.struct("exported_at", "delim", "header_text", "file_year")).alias("h")).select(*FILE, "h.*")
    delims = sorted(r[0] for r in last.select("delim").distinct().collect() if r[0])
    name = lambda x: F.regexp_replace(_unquoted(x), r'(?U)^[\s\p{Cf}"]+|[\s\p{Cf}"]+$', "")
    # a header is read leniently: blanks around separators go first, and broken quoting falls back to a plain split
    tight = _per_delimiter(delims, lambda d: F.regexp_replace(F.regexp_replace("header_text", "^[ \u00a0\ufeff]+|[ \u00a0\r\n]+$", ""), rf"[ \u00a0]*{_escaped(d)}[ \u00a0]*", d), "string")
    body = F.coalesce(tight, F.lit(""))
    raw = F.coalesce(_fields(delims, body), _per_delimiter(delims, lambda d: F.split(body, _escaped(d))), F.array().cast("array<string>"))
    again = lambda x, i: F.size(F.filter(F.slice("names", F.lit(1), i), lambda y: y == x))
    number = lambda x, i: F.when(again(x, i) > 0, F.concat(x, F.lit(" ("), (again(x, i) + 1).cast("string"), F.lit(")"))).otherwise(x)
    out = last.withColumn("names", F.transform(raw, name)).withColumn("names", F.transform("names", number)).drop("header_text")
    w = Window.partitionBy("_source_folder").orderBy("exported_at", "_source_file")
    out = out.withColumn("prior_file", F.lag("_source_file").over(w)).withColumn("prior_names", F.lag("names").over(w)).withColumn("next_names", F.lead("names").over(w))
    return cut_lineage(out), delims


def _body(text: str = "raw_text") -> Column:
    """The record without the line ends at its end."""
    return F.rtrim(F.coalesce(text, F.lit("")), F.lit("\r\n"))


def value_class(v: Column) -> Column:
    """Class letter of one trimmed value."""
    as_day = F.regexp_replace(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    day = lambda kind: F.when(as_day.try_cast("date").isNull(), NO_DAY).otherwise(kind)
    short = F.length(v) <= 10  # no day is longer
    return (
        F.when(v == "", BLANK).when(~F.substring(v, 1, 1).between("0", "9"), F.when(F.lower(v).isin("yes", "no", "true", "false"), TRUTH).otherwise(TEXT))
        .when(v.rlike(r"^[0-9]+$"), WHOLE).when(short & v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day(YMD)).when(short & v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day(DMY))
        .when(v.rlike(r"^[0-9]+\.[0-9]+$"), DECIMAL).otherwise(TEXT)
    )


def split_records(raw: DataFrame, export_files: DataFrame, id_field: str = "Lens ID") -> DataFrame:
    """Every record with its header's ``names``, the parsed ``fields`` (null if the quoting is broken), the class
    of each field and the first structural ``reason``. No row is lost and the raw text stays in place."""
    return _split(raw, *headers(export_files), id_field)


def _split(raw: DataFrame, head: DataFrame, delims: list[str], id_field: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    id_at = F.array_position(F.transform("names", plain), plain(F.lit(id_field))).cast("int")
    head = small_side(head.select(*FILE, "delim", "names", "file_year", id_at.alias("id_at")))
    keep = [c for c in raw.columns if c in ("raw_id", *FILE, "record_no", "raw_text", "read_at")]
    x = over_cores(raw.select(*keep), "raw_id").join(head, FILE, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    x = x.withColumn("parts", _fields(delims, _body()))
    reason = (
        F.when(F.col("delim").isNull(), "too_many_fields").when(F.col("parts").isNull(), "broken_quoting")
        .when(F.size("parts") > F.size("names"), "too_many_fields").when(F.size("parts") < F.size("names"), "too_few_fields")
    )
    x = x.withColumn("reason", reason).withColumn("fields", F.transform("parts", lambda p: strip(_unquoted(p)))).drop("parts")
    bad_id = F.when(F.col("id_at") > 0, ~F.get("fields", F.col("id_at") - 1).rlike(r"^\d{3}-\d{3}-\d{3}-\d{3}-\d{3}$")).otherwise(False)
    x = x.withColumn("bad_id", F.when(F.col("reason").isNull(), bad_id)).drop("id_at")
    return x.withColumn("classes", F.when(F.col("reason").isNull(), F.transform("fields", value_class)))


def _type_of(prefix: str = "") -> Column:
    """Type letter from the counts of the classes; null if no value is filled."""
    n = lambda *k: sum((F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)) for c in k), F.lit(0))
    total = n(*"wftydzx")
    most = lambda *k: n(*k) >= NEARLY_ALL * total
    return (
        F.when(total == 0, F.lit(None)).when(most(WHOLE), WHOLE).when(most(WHOLE, DECIMAL), DECIMAL).when(most(TRUTH), TRUTH)
        .when(most(YMD), YMD).when(most(DMY), DMY).otherwise(TEXT)
    )


def field_types(records: DataFrame) -> DataFrame:
    """Per file and field position the counts of every class over the records that pass the structural and ID
    checks, and the ``type`` that nearly all filled values have. Values that do not load under it are few by definition."""
    ok = records.where(F.col("reason").isNull() & ~F.col("bad_id"))
    counts = ok.select(*FILE, F.posexplode("classes").alias("pos", "class")).groupBy(*FILE, "pos").agg(*[F.count_if(F.col("class") == c).alias(c) for c in "bwftydzx"])
    return counts.withColumn("type", _type_of())


def _file_types(records: DataFrame) -> DataFrame:
    """Per file the types of its fields by position."""
    return field_types(records).groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("t")).select(*FILE, F.col("t.type").alias("types"))


def _refused(records: DataFrame, types: DataFrame) -> DataFrame:
    """``records`` (FILE, reason, bad_id, classes) with ``fail_reason`` under the types of their files."""

    def wrong(z: Column) -> Column:
        out = F.lit(False)
        for kind, loads in LOADS.items():
            out = out | ((z["types"] == kind) & ~z["classes"].isin(*loads))
        return F.coalesce(out, F.lit(False))

    bad = F.exists(F.arrays_zip("types", "classes"), wrong)
    x = records.join(small_side(types), FILE, "left")
    invalid = F.coalesce("bad_id", F.lit(False)) | F.coalesce(bad, F.lit(False))
    return x.withColumn("fail_reason", F.coalesce("reason", F.when(invalid, "invalid_value"))).drop("types")


def failing_records(raw: DataFrame, export_files: DataFrame, id_field: str = "Lens ID") -> DataFrame:
    """(raw_id, FILE, fail_reason) of the records that fail, with the first reason that holds: broken_quoting,
    too_many_fields, too_few_fields, invalid_value. Each record is read once: as types need all records first, what is
    kept of it meanwhile is its reason and one letter per field, not its text."""
    one = _split(raw, *headers(export_files), id_field)
    recs = written(one.select("raw_id", *FILE, "reason", "bad_id", F.array_join("classes", "").alias("letters")))
    classed = recs.withColumn("classes", F.when(F.col("letters") != "", F.split("letters", ""))).drop("letters")
    return _refused(classed, cut_lineage(_file_types(classed))).where("fail_reason is not null").select("raw_id", *FILE, "fail_reason")


def load_records(raw: DataFrame, export_files: DataFrame, id_field: str = "Lens ID") -> DataFrame:
    """All records with ``fail_reason`` (null: it loads), the retained ``_corrupt_record`` of failing ones, and
    ``fields`` of loading ones, as ``failing_records`` tells them apart. Records are read twice, first for the types of
    their files, and nothing of them is kept in between."""
    one = _split(raw, *headers(export_files), id_field)
    x = _refused(one, cut_lineage(_file_types(one)))
    fails = F.col("fail_reason").isNotNull()
    keep = [c for c in one.columns if c not in ("names", "fields", "file_year", "classes")]
    return x.select(*keep, "fail_reason", F.when(fails, F.coalesce("raw_text", F.lit(""))).alias("_corrupt_record"), F.when(~fails, F.col("fields")).alias("fields"))


def _features(v: Column, file_year: Column) -> Column:
    """Content features of one value, alike for the same content in another writing: the number (also with a
    unit), the truth value, the year of a date as seen from the file's year, else its words with digits folded."""
    low = F.lower(v)
    number = F.regexp_extract(low, r"^([0-9]{1,15})(?:\.[0-9]+)?(?: [a-z]+)?$", 1)
    size = number.try_cast("bigint")
    as_number = F.when(size < 32, F.concat(F.lit("n"), size.cast("string"))).otherwise(F.concat(F.lit("N"), F.floor(F.log2(size)).cast("string")))
    year = F.regexp_extract(v, r"^(?:\d{1,2}/\d{1,2}/)?(\d{4})(?:-\d{1,2}-\d{1,2})?$", 1)
    words = F.filter(F.split(F.regexp_replace(low, r"[0-9]+", "0"), r"[^\p{L}0]+"), lambda w: w != "")
    as_words = F.transform(words, lambda w: F.concat(F.lit("w"), F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("string")))
    return (
        F.when(v == "", F.array().cast("array<string>")).when(low.isin("yes", "true"), F.array(F.lit("n1"))).when(low.isin("no", "false"), F.array(F.lit("n0")))
        .when((year != "") & (F.length(v) >= 8), F.array(F.concat(F.lit("d"), (year.try_cast("int") - F.coalesce(file_year, F.lit(0))).cast("string")))).when(number != "", F.array(as_number)).otherwise(as_words)
    )


def _contents(raw: DataFrame, head: DataFrame, delims: list[str], id_field: str) -> DataFrame:
    """Per file its header, that of the file before it, and ``content``: field -> mark -> count, where marks are the
    classes of the field's values and, if it comes or goes, the features of what they say. One pass over all records;
    what it leaves has at most files x fields x (8 + features) entries."""
    none = F.array().cast("array<string>")
    moves = head.select(
        *FILE, F.coalesce(F.array_except("names", F.coalesce("prior_names", "names")), none).alias("comes"),
        F.coalesce(F.array_except("names", F.coalesce("next_names", "names")), none).alias("goes"),
    )
    # bad records give an empty list and are dropped behind the explode: a filter on the parsed columns would be
    # moved below the parsing and so parse every record again
    recs = _split(raw, head, delims, id_field).join(small_side(moves), FILE, "left")
    ok = F.col("reason").isNull() & ~F.col("bad_id")
    moving = F.transform("names", lambda n: F.array_contains("comes", n) | F.array_contains("goes", n))
    values = F.when(ok, F.arrays_zip("names", "classes", "fields", moving.alias("moving")))
    one = recs.select(*FILE, "file_year", F.explode_outer(values).alias("f"))
    marks = F.concat(F.array(F.concat(F.lit("="), F.col("f.classes"))), F.when(F.col("f.moving"), _features(F.col("f.fields"), F.col("file_year"))).otherwise(none))
    stats = one.select(*FILE, F.col("f.names").alias("name"), F.explode_outer(marks).alias("mark")).groupBy(*FILE, "name", "mark").agg(F.count("*").alias("n")).where("mark is not null")
    per = stats.groupBy(*FILE, "name").agg(F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("marks"))
    files = per.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("name", "marks"))).alias("content"))
    x = head.select(*FILE, "exported_at", "names", "prior_file", "prior_names").join(files, FILE, "left")
    return x.withColumn("prior_content", F.lag("content").over(Window.partitionBy("_source_folder").orderBy("exported_at", "_source_file")))


def _type(marks: dict[str, int] | None) -> str | None:
    """As ``_type_of``, from the marks of a field."""
    n = {k[1]: v for k, v in (marks or {}).items() if k[0] == "="}
    total = sum(n.get(c, 0) for c in "wftydzx")
    if not total:
        return None
    for kind, counted in ((WHOLE, WHOLE), (DECIMAL, WHOLE + DECIMAL), (TRUTH, TRUTH), (YMD, YMD), (DMY, DMY)):
        if sum(n.get(c, 0) for c in counted) >= NEARLY_ALL * total:
            return kind
    return TEXT


def _alike(a: dict[str, int], b: dict[str, int]) -> float:
    """Bhattacharyya coefficient of the features of two fields."""
    p, q = ({k: v for k, v in x.items() if k[0] != "="} for x in (a, b))
    size = math.sqrt(sum(p.values()) * sum(q.values()))
    return sum(math.sqrt(v * q[k]) for k, v in sorted(p.items()) if k in q) / size if size else 0.0


def file_changes(names: list[str], prior: list[str], content: dict, prior_content: dict, same_content: float) -> list[tuple[str, str, str]]:
    """(change_kind, field_name, new_name) of a file against the one before it."""
    comes, goes = ([x for x in dict.fromkeys(a) if x not in b] for a, b in ((names, prior), (prior, names)))
    pairs = sorted((-round(s, 12), o, n) for n in comes for o in goes if (s := _alike(content.get(n, {}), prior_content.get(o, {}))) >= same_content)
    renamed: dict[str, str] = {}
    for _, o, n in pairs:
        if n not in renamed and o not in renamed.values():
            renamed[n] = o
    kept = {n: n for n in names if n in prior} | renamed
    types = ((n, _type(prior_content.get(o)), _type(content.get(n))) for n, o in kept.items())
    return [
        *(("added", n, n) for n in comes if n not in renamed), *(("removed", o, "") for o in goes if o not in renamed.values()),
        *(("renamed", o, n) for n, o in renamed.items()), *(("retyped", n, n) for n, a, b in types if a and b and a != b),
    ]


def layout_changes(raw: DataFrame, export_files: DataFrame, id_field: str = "Lens ID", same_content: float = 0.7) -> DataFrame:
    """Each change of a file's layout against the file exported before it in its folder: added, removed, renamed,
    retyped. A removed and an added field of one file are a rename if their contents agree: the Bhattacharyya
    coefficient of their feature histograms is at least ``same_content``; pairs are taken best first.

    One pass over all records leaves the counts of every field's classes and, of fields that come or go, of their
    features; each file is then compared with the one before it. A file without valid records changes no type; ties
    between equally similar pairs go to the alphabetically first names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                content, before = ({f: dict(m) for f, m in dict(x).items()} if x is not None else {} for x in (r.content, r.before))
                rows += [(r.folder, r.file, *c) for c in file_changes(list(r.names), list(r.prior_names), content, before, same_content)]
            yield pd.DataFrame(rows, columns=[*FILE, "change_kind", "field_name", "new_name"])

    x = _contents(raw, *headers(export_files), id_field).where("prior_file is not null")
    x = x.select(F.col("_source_folder").alias("folder"), F.col("_source_file").alias("file"), "names", "prior_names", "content", F.col("prior_content").alias("before"))
    return x.mapInPandas(run, "_source_folder string, _source_file string, change_kind string, field_name string, new_name string")


def field_versions(raw: DataFrame, export_files: DataFrame) -> DataFrame:
    """Type alternatives of every field in every file: counts by class and the type taken."""
    head, delims = headers(export_files)
    names = head.select(*FILE, F.posexplode("names").alias("pos", "field_name"))
    label = F.create_map(*[F.lit(v) for kv in {WHOLE: "whole number", DECIMAL: "decimal number", TRUTH: "truth value", YMD: "date, year first", DMY: "date, day first", TEXT: "text"}.items() for v in kv])
    t = field_types(_split(raw, head, delims, "Lens ID"))
    return t.join(small_side(names), [*FILE, "pos"]).select(*FILE, "field_name", F.element_at(label, F.col("type")).alias("field_type"), F.col(WHOLE).alias("n_whole"), F.col(DECIMAL).alias("n_decimal"), F.col(TRUTH).alias("n_truth"), F.col(YMD).alias("n_year_first"), F.col(DMY).alias("n_day_first"), (F.col(TEXT) + F.col(NO_DAY)).alias("n_text"), F.col(BLANK).alias("n_blank"))


@dataclass
class Field:
    """One field through the files of the folders: its names, the last first, and where it stands in which file."""

    name: str
    names: list[str]
    at: dict[tuple[str, str], int] = field(default_factory=dict)
    types: dict[tuple[str, str], str] = field(default_factory=dict)


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum()) or name


def follow_fields(files: list[dict]) -> list[Field]:
    """The fields of one folder. ``files``, in order of export: file key, names, types by name, and its renames (new name
    -> old name). A name that comes back is the field that last had it, unless that is there under another name."""
    known: list[Field] = []
    alive: dict[str, Field] = {}
    for f in files:
        now: dict[int, Field] = {}
        taken = lambda x: any(x is y for y in now.values())
        order = sorted(range(len(f["names"])), key=lambda i: f["names"][i] not in alive and f["names"][i] not in f["renames"])
        for i in order:  # what goes on comes first, then what is new
            n = f["names"][i]
            old = alive.get(f["renames"].get(n, n)) or next((x for x in reversed(known) if x.names[0] == n), None)
            if old is None or taken(old):
                old = Field(n, [])
                known.append(old)
            old.names = [n, *(x for x in old.names if x != n)]
            old.at[f["file"]] = i
            if f["types"].get(n):
                old.types[f["file"]] = f["types"][n]
            now[i] = old
        alive = {f["names"][i]: x for i, x in now.items()}
    return known


def canonical_fields(folders: list[list[dict]]) -> list[Field]:
    """The columns of the one table: fields of different folders that ever had the same plain name are one. Every column
    has the first name of its field, numbered where another column has it."""
    out: list[Field] = []
    for files in folders:
        mine = follow_fields(files)
        joined: list[Field] = []
        for f in mine:
            ours = {_plain(n) for n in f.names}
            fits = [c for c in out if not any(c is j for j in joined) and ours & {_plain(n) for n in c.names}]
            best = next((c for c in fits if _plain(c.name) == _plain(f.name)), fits[0] if fits else None)
            if best is None:
                joined.append(Field(f.name, list(f.names), dict(f.at), dict(f.types)))
            else:
                best.names += [n for n in f.names if n not in best.names]
                best.at |= f.at
                best.types |= f.types
                joined.append(best)
        out += [j for j in joined if not any(j is c for c in out)]
    used = {c.lower() for c in ("raw_id", *FILE)}
    for c in out:
        name, k = c.name or "unnamed", 2
        while name.lower() in used:
            name, k = f"{c.name or 'unnamed'} ({k})", k + 1
        used.add(name.lower())
        c.name = name
    return out


def _as_day(v: Column) -> Column:
    return F.regexp_replace(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1").try_cast("date")


#: Type -> branch of a column and how its values are read. Whole numbers keep 38 digits.
BRANCHES = {
    WHOLE: ("whole", lambda v: v.try_cast("decimal(38,0)")), DECIMAL: ("decimal", lambda v: v.try_cast("double")),
    TRUTH: ("truth", lambda v: F.lower(v).isin("yes", "true")), YMD: ("day", _as_day), DMY: ("day", _as_day), TEXT: ("text", lambda v: v),
}


def _column(i: int, types: set[str]) -> Column:
    """Column ``i`` of the table from ``fields``, ``at`` (its place in the record's file, -1: none) and ``kinds`` (its type
    there). One type: that type (whole and decimal numbers: decimal; both writings of a date: day). Else branches, of
    which the one of the file's type is set, and the canonical text."""
    v = F.get("fields", F.get("at", i))
    v = F.when(v != "", v)
    types = {DECIMAL if t == WHOLE and DECIMAL in types else t for t in types or {TEXT}}
    by_branch = {BRANCHES[t][0]: BRANCHES[t][1] for t in (WHOLE, DECIMAL, TRUTH, YMD, DMY, TEXT) if t in types}
    if len(by_branch) == 1:
        return next(iter(by_branch.values()))(v)
    kind = F.get("kinds", i)
    of = {"whole": (WHOLE,), "decimal": (WHOLE, DECIMAL), "truth": (TRUTH,), "day": (YMD, DMY), "text": (TEXT,)}
    text = F.when(kind.isin(YMD, DMY), _as_day(v).cast("string")).when(kind == TRUTH, F.lower(v).isin("yes", "true").cast("string")).otherwise(v)
    return F.when(v.isNotNull(), F.struct(*[F.when(kind.isin(*of[b]), read(v)).alias(b) for b, read in by_branch.items()], text.alias("canonical")))


def unified_table(raw: DataFrame, export_files: DataFrame, id_field: str = "Lens ID", same_content: float = 0.7) -> DataFrame:
    """All loading records of all files in one table: raw_id, FILE, and one typed column per field through all its names
    and files; blank values and fields that a file does not have are null. Where the files of a field differ in type
    (beyond whole and decimal numbers, or the two writings of a date), its column has a branch per type and the
    ``canonical`` text: days year first, truth values true or false.

    Records are read twice: for the layouts, then for the rows. The driver holds header metadata only (names and types
    per file)."""
    head, delims = headers(export_files)
    spark, rows = raw.sparkSession, []
    for r in cut_lineage(_contents(raw, head, delims, id_field)).toLocalIterator():
        content, before = r["content"] or {}, r["prior_content"] or {}
        changes = file_changes(r["names"], r["prior_names"], content, before, same_content) if r["prior_file"] is not None else []
        rows.append({"folder": r["_source_folder"], "file": (r["_source_folder"], r["_source_file"]), "when": r["exported_at"], "names": r["names"], "types": {n: _type(m) for n, m in content.items()}, "renames": {n: o for k, o, n in changes if k == "renamed"}})
    rows.sort(key=lambda f: (f["folder"] or "", f["when"] is not None, f["when"], f["file"][1] or ""))
    columns = canonical_fields([[f for f in rows if f["folder"] == d] for d in dict.fromkeys(f["folder"] for f in rows)])
    places = [(*f["file"], [c.at.get(f["file"], -1) for c in columns], [c.types.get(f["file"], TEXT) for c in columns], [f["types"].get(n) for n in f["names"]]) for f in rows]
    table = small_side(spark.createDataFrame(places, "_source_folder string, _source_file string, at array<int>, kinds array<string>, types array<string>"))
    one = _split(raw, head, delims, id_field).select("raw_id", *FILE, "reason", "bad_id", "fields", "classes")
    x = _refused(one, table.select(*FILE, "types")).join(table.drop("types"), FILE, "left")
    # loading rows by an explode, as a filter would be moved below the parsing and parse every record again
    x = x.select("raw_id", *FILE, "at", "kinds", F.explode(F.when(F.col("fail_reason").isNull(), F.array("fields"))).alias("fields"))
    return x.select("raw_id", *FILE, *[_column(i, set(c.types.values())).alias(c.name) for i, c in enumerate(columns)])
