"""VCF: the header gives the schema, and rows become typed columns in one pass without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.variants import ancestral_policy, common_prefix, genotype, sv_type, symbolic

TYPES = {"Integer": "int", "Float": "float", "String": "string", "Character": "string", "Flag": "boolean"}
_META = re.compile(r'##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,>]+)')


def _bound(value: Column, of) -> Column:
    """of(value), with the value worked out once however often it is named: expressions within lambdas are evaluated at every mention."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _head(spark: SparkSession, path: str) -> list[str]:
    """The lines before the first row, of files in order of their names: as many are taken from a file's beginning as it needs."""
    found = []
    for file in sorted(spark.read.text(path).inputFiles()):
        n, lines = 256, None
        while lines is None or len(lines) == n and lines[-1].startswith("#"):
            n *= 4
            lines = [r["value"] for r in spark.read.text(file).take(n)]
        rows = next((i for i, x in enumerate(lines) if not x.startswith("#")), len(lines))
        found += lines[:rows]
        if rows < len(lines):  # what a file holds behind its first row isn't its header
            break
    return found


def header(spark: SparkSession, path: str) -> tuple[dict, dict, list[str]]:
    """INFO and FORMAT fields (id -> (number, type)) and the samples, from what stands before the first row."""
    lines = _head(spark, path)
    fields = {"INFO": {}, "FORMAT": {}}
    for line in lines:
        if m := _META.match(line):
            fields[m[1]][m[2]] = (m[3], TYPES[m[4]])
    names = next((x.split("\t")[9:] for x in lines if x.startswith("#CHROM")), [])
    return fields["INFO"], fields["FORMAT"], names


def depth(number: str) -> int | None:
    """Values a field has for one ALT: its number, A 1, R and G 2; None if it varies."""
    return {"A": 1, "R": 2, "G": 2, ".": None}.get(number, int(number) if number.isdigit() else None)


def _typed(text: Column, number: str, kind: str, default) -> Column:
    """One value, or an array of them; a count other than the header's is an error."""
    fill = F.lit(default if default is not None else ("" if kind == "string" else 0)).cast(kind)
    one = lambda x: F.coalesce(F.when(x != ".", x).try_cast(kind), fill)
    n = depth(number)
    if n == 1:
        return one(text)
    many = F.transform(F.split(text, ","), one)
    if n is None:
        return many
    empty = F.array_repeat(fill, n)
    wrong = F.raise_error(F.lit("another count than the header's")).cast(f"array<{kind}>")
    return F.when(text.isNull() | (text == "."), empty).otherwise(_bound(many, lambda m: F.when(F.size(m) == n, m).otherwise(wrong)))


def split_alleles(rows: DataFrame, info_fields: dict, fmt_fields: dict) -> DataFrame:
    """A row an ALT of rows(ALT, INFO, FORMAT, _samples): values of Number A, R and G follow their allele, and other alleles of a GT become 0."""
    alts = F.split("ALT", ",")
    # the list of alleles is exploded as it is: an array column would be evaluated again for a filter
    rows = rows.select("*", F.posexplode(alts).alias("_k", "_alt")).withColumn("ALT", F.col("_alt"))
    k = F.col("_k") + 1
    pair = (k * (k + 1) / 2).cast("int")  # the place of genotype 0/k among all

    def picked(value: Column, places: list) -> Column:
        chosen = lambda v: F.concat_ws(",", *(F.coalesce(F.get(v, p), F.lit(".")) for p in places))
        return F.when(value == ".", value).otherwise(_bound(F.split(value, ","), chosen))

    by_number = {"A": [k - 1], "R": [F.lit(0), k], "G": [F.lit(0), pair, pair + k]}

    def follows(name: Column, value: Column, fields: dict) -> Column:
        out = value
        for number, places in by_number.items():
            names = [n for n, (m, _) in fields.items() if m == number]
            if names:
                out = F.when(name.isin(*names), picked(value, places)).otherwise(out)
        return out

    def entry(e: Column) -> Column:
        value = lambda name: e.substr(F.length(name) + 2, F.length(e))
        followed = lambda name: F.concat(name, F.lit("="), _bound(value(name), lambda v: follows(name, v, info_fields)))
        return F.when(e.contains("="), _bound(F.substring_index(e, "=", 1), followed)).otherwise(e)

    def genotype_of(gt: Column) -> Column:
        tokens = F.regexp_extract_all(gt, F.lit("[0-9]+|[./|]"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(t == k.cast("string"), "1").when(t.rlike("^[0-9]+$"), "0").otherwise(t)), "")

    def samples(keys: Column) -> Column:
        part = lambda v, i: _bound(F.get(keys, i), lambda key: F.when(key == "GT", genotype_of(v)).otherwise(follows(key, v, fmt_fields)))
        return F.transform("_samples", lambda s: F.array_join(F.transform(F.split(s, ":"), part), ":"))

    several = F.col("ALT_").contains(",")
    rows = rows.withColumns({
        "INFO": F.when(several, F.array_join(F.transform(F.split("INFO", ";"), entry), ";")).otherwise(F.col("INFO")),
        "_samples": F.when(several, _bound(F.split("FORMAT", ":"), samples)).otherwise(F.col("_samples")),
    })
    return rows.drop("_k", "_alt")


def faults(rows: DataFrame) -> DataFrame:
    """rows(REF, ALT, ...) with `fault`: what a strict reader would refuse a row for, else null."""
    ref, alt = F.upper("REF"), F.upper("ALT")
    known = alt.rlike("^[ACGTN]+$|^<[^<>]+>$|^[.*]$") | alt.rlike(r"[\[\]]")
    fault = (
        F.when(F.col("ALT").contains(","), "multi-allelic").when(~ref.rlike("^[ACGTN]+$"), "bad REF").when(~known, "bad ALT")
        .when((F.length(ref) > 1) & (F.length(alt) > 1) & alt.rlike("^[ACGTN]+$") & (ref.substr(1, 1) == alt.substr(1, 1)), "not normalised")
    )
    return rows.withColumn("fault", fault)


def read(spark: SparkSession, path: str, info: dict | list = (), fmt: dict | list = (), ancestral: str = "error", validate: bool = True, split: bool = False) -> DataFrame:
    """chrom, start_pos, end_pos, ref, alt, id, the INFO fields asked for, and `samples`: an array of structs of FORMAT fields.

    info and fmt name fields, with a default for each if they are dicts. GT is a genotype code
    and SVTYPE a structural one. Multi-allelic rows are an error, or become a row an
    allele with `split`. A breakend keeps its mate's name as it is; joined before, it loses the end that it shares with REF.
    """
    info_fields, fmt_fields, names = header(spark, path)
    rows = spark.read.text(path).where("value NOT LIKE '#%' AND value <> ''")
    p = F.split("value", "\t")
    rows = rows.select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("long").alias("pos"), F.get(p, F.lit(2)).alias("id"), F.upper(F.get(p, F.lit(3))).alias("REF"), F.get(p, F.lit(4)).alias("ALT"), F.get(p, F.lit(7)).alias("INFO"), F.get(p, F.lit(8)).alias("FORMAT"), F.slice(p, 10, F.greatest(F.size(p) - 9, F.lit(0))).alias("_samples"))
    rows = ancestral_policy(rows, "ALT", ancestral)
    if split:
        rows = split_alleles(rows.withColumn("ALT_", F.col("ALT")), info_fields, fmt_fields)
    if validate:
        rows = rows.withColumn("ALT", F.when(F.col("ALT").contains(","), F.raise_error(F.lit("a multi-allelic row")).cast("string")).otherwise(F.col("ALT")))
    value = lambda name: F.nullif(F.regexp_extract(F.col("INFO"), rf"(?:^|;){name}=([^;]*)", 1), F.lit(""))
    breakend, ahead = F.col("ALT").rlike(r"[\[\]]"), F.col("ALT").rlike(r"^[\[\]]")
    tail = F.upper(F.regexp_extract("ALT", r"[A-Za-z]*$", 0))
    rows = rows.withColumn("_end", F.when(ahead, common_prefix(F.reverse("REF"), F.reverse(tail))).otherwise(0))
    rows = rows.withColumn("_pad", F.when(ahead, 0).otherwise(common_prefix(F.col("REF"), F.upper("ALT"))))
    pad = F.col("_pad")
    sym = F.col("ALT").startswith("<")
    s = symbolic(F.col("pos"), F.col("REF"), value("END").cast("long"), value("SVLEN").cast("long"))
    start = F.when(sym, s["start_pos"]).otherwise(F.col("pos") - 1 + pad)
    left = lambda c: F.col(c).substr(pad + 1, F.length(c) - pad - F.col("_end"))
    ref = F.when(sym, "").otherwise(left("REF"))
    out = {
        "start_pos": start, "end_pos": F.when(sym, s["end_pos"]).otherwise(start + F.length(ref)), "ref": ref,
        "alt": F.when(sym | (F.col("ALT") == "."), F.when(sym, F.col("ALT")).otherwise("")).otherwise(F.when(breakend, left("ALT")).otherwise(F.upper(left("ALT")))),
    }
    default = lambda of, n: of.get(n) if isinstance(of, dict) else None
    chosen = []
    for n in info:
        if n == "ID":
            chosen.append(F.col("id").alias("ID"))
            continue
        number, kind = info_fields[n]
        if kind == "boolean":
            chosen.append(F.col("INFO").rlike(rf"(?:^|;){n}(?:;|$)").alias(n))
        else:
            chosen.append((sv_type(value(n)) if n == "SVTYPE" else _typed(value(n), number, kind, default(info, n))).alias(n))
    if fmt:
        def field(n: str):
            return lambda text: genotype(F.coalesce(text, F.lit("./."))) if n == "GT" else _typed(text, *fmt_fields[n], default(fmt, n))

        def fields(places: Column):
            at = lambda parts, i: F.when(F.get(places, F.lit(i)) > 0, F.get(parts, (F.get(places, F.lit(i)) - 1).cast("int")))
            one = lambda parts: F.struct(*(_bound(at(parts, i), field(n)).alias(n) for i, n in enumerate(fmt)))
            return F.transform("_samples", lambda x: _bound(F.split(x, ":"), one))

        # a row's keys are looked up once, and a sample is split once
        places = _bound(F.split("FORMAT", ":"), lambda keys: F.array(*(F.array_position(keys, n) for n in fmt)))
        chosen.append(_bound(places, fields).alias("samples"))
    return rows.select("chrom", *(c.alias(k) for k, c in out.items()), "id", *chosen) if "ID" not in info else rows.select("chrom", *(c.alias(k) for k, c in out.items()), *chosen)


def sample_names(spark: SparkSession, path: str) -> list[str]:
    return header(spark, path)[2]
