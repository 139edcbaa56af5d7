import datetime as dt
import random

from pyspark.sql import functions as F

from labtables.functions import documents as D
from labtables.functions import text as T
from labtables.sources import readers as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_flowcell_date(spark):
    cases = {
        "20240131_A_B": dt.date(2024, 1, 31),
        "240115_A": dt.date(2024, 1, 15),  # six digits are a short year, not year 2401
        "231231_A": dt.date(2023, 12, 31),
        "970131_A": dt.date(1997, 1, 31),
        "690101": dt.date(1969, 1, 1),
        "680101": dt.date(2068, 1, 1),
        "20240230_A": None,
        "2024013_A": None,
        "abc_20240131": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "fc string")
    found = {r.fc: r.d for r in df.withColumn("d", T.flowcell_date("fc")).collect()}
    assert found == cases


def test_read_layout(spark):
    layout = one(spark, T.read_layout(F.lit("151-8-10-148")))
    assert layout.asDict() == {
        "r1_cdna": "cDNA(23-151)",
        "r1_umi": "UMI(12-19)",
        "r2": "cDNA(1-148)",
        "i1": "BC(1-8)",
        "i2": "BC(1-10)",
    }
    assert one(spark, T.read_layout(F.lit("151-8-10"))) is None


def test_species_key(spark):
    cases = [
        ("Human (Homo sapiens, GRCh38)", "x", "homo sapiens"),
        ("Other (-, -)", " Mouse ", "mouse"),
        ("Thing (-, v1)", "Zebrafish", "zebrafish"),
        ("Thing (Other, v1)", "Zebrafish", "zebrafish"),
        ("", "Rat", "rat"),
        (None, "Rat", "rat"),
        (None, None, None),
        ("Human", "Human", None),
    ]
    df = spark.createDataFrame([(g, o) for g, o, _ in cases], "g string, o string")
    found = [r.x for r in df.select(T.species_key("g", "o").alias("x")).collect()]
    assert found == [x for _, _, x in cases]


def test_organism_common(spark):
    cases = [
        (" Human (Homo sapiens, v)", "mouse", "human"),
        ("Yeti (Y, v)", " Mouse", "mouse"),
        ("other (-, -)", "Human", "human"),
        ("Yeti (Y, v)", "yeti", None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(g, o) for g, o, _ in cases], "g string, o string")
    column = T.organism_common("g", "o", ["human", "mouse"])
    assert [r.x for r in df.select(column.alias("x")).collect()] == [x for _, _, x in cases]


def test_feature_and_origin(spark):
    cases = [
        # case, id, customer name, option, method -> feature, origin
        ("old_format", "P1_1", "S1_GE_x", "", "", "gex", "S1"),
        ("old_format", "P1_2", "S1_TC_GE", "", "", "gex", "S1_TC"),  # first configured wins
        ("old_format", "P1_3", "S1", "3' GEX kit", "", "gex", "P1_3"),
        ("old_format", "P1_4", None, "ATAC", "", "atac", "P1_4"),
        ("new_format", "S12", None, "", "", "vdj", "S1"),
        ("new_format", "S19", None, "", "5GEX", "gex", "S19"),
        ("new_format", "S19", None, "", "other", "unknown", "S19"),
        ("new_format", "2", None, "", "", "vdj", "unknown_sample_id"),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "c string, i string, n string, o string, m string")
    column = T.feature_and_origin("c", "i", "n", "o", "m", [("GE", "gex"), ("TC", "vdj")], {"1": "gex", "2": "vdj"})
    found = [(r.x.feature, r.x.origin) for r in df.select(column.alias("x")).collect()]
    assert found == [c[5:] for c in cases]


def test_fastq_role(spark):
    cases = {
        "/a/S_S1_R1_001.fastq.gz": "R1",
        "/a_R2_/S_S1_I2_001.fq.gz": "I2",
        "S_R1_I1_.fq.gz": "R1",
        "/a/S_S1_R1_001.fastq.gz.md5": None,
        "/a/S_S1_X1_001.fastq.gz": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r.p: r.x for r in df.withColumn("x", T.fastq_role("p")).collect()} == cases


def test_job_id(spark):
    assert one(spark, T.job_id_from_text(F.lit("Submitted batch job 123456 on 7"))) == "123456"
    assert one(spark, T.job_id_from_text(F.lit("no"))) is None


def test_logs(spark):
    log = "x\nweb_summary:   /b.html\nRun summary HTML: /a.html\nPipestance completed successfully!\n"
    assert one(spark, T.report_path(F.lit(log))) == "/a.html"  # order of patterns, not of lines
    assert one(spark, T.report_path(F.lit("web_summary: /b.html"))) == "/b.html"
    assert one(spark, T.report_path(F.lit("none"))) is None
    assert one(spark, T.run_succeeded(F.lit(log))) is True
    assert one(spark, T.run_succeeded(F.lit("failed"))) is False


def reference_version(text, phrase):
    for line in reversed(text.split("\n")):
        if phrase in line:
            return line.split()[-1]
    return "--"


def test_tool_version_against_line_by_line(spark):
    phrase = "zUMIs version"
    texts = [
        "a\nzUMIs version 2.9.7\nb",
        "zUMIs version 1\nzUMIs version 2.9.7  \n",
        "zUMIs version\nrest 5",
        "using zUMIs version2.9 now",
        "zUMIs version 1 zUMIs version 2",
        "nothing\nhere",
        "zUMIs version 3",
        "zUMIs version",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.x for r in df.select(T.tool_version("t").alias("x")).collect()]
    assert found == [reference_version(t, phrase) for t in texts]


def test_missing_fields_tells_null_from_absent(spark):
    df = spark.createDataFrame(
        [('{"a": null, "b": {"c": 1}, "status_(manual)": 1}',), ('{"b": 3}',), ('{"b": {"c": null}}',), ("bad",)],
        "t string",
    )
    missing = D.missing_fields(F.try_parse_json("t"), ["a", "b.c", "status_(manual)"])
    assert [r.x for r in df.select(missing.alias("x")).collect()] == [
        [],
        ["a", "b.c", "status_(manual)"],
        ["a", "status_(manual)"],
        ["a", "b.c", "status_(manual)"],
    ]


def test_user_info_is_not_swapped(spark):
    owner = F.struct(F.lit("o@x").alias("email"), F.lit("O").alias("name"))
    fields = F.create_map(
        *[F.lit(x) for x in ("project_lab_email", "lab@x", "project_lab_name", "Lab", "project_pi_email", "pi@x")]
    )
    info = one(spark, D.user_info(owner, fields))
    assert info["lab"].asDict() == {"email": "lab@x", "name": "Lab"}
    assert info["pi"].asDict() == {"email": "pi@x", "name": ""}
    assert info["bioinformatician"].asDict() == {"email": "", "name": ""}
    assert one(spark, D.contact_email(D.user_info(owner, fields), "pi")) == "pi@x"


def test_sensitive(spark):
    assert one(spark, D.is_sensitive(F.lit("YES"))) is True
    assert one(spark, D.is_sensitive(F.lit(None).cast("string"))) is False
    assert one(spark, D.delivery_sensitive(F.lit(None).cast("boolean"))) is True


def test_lines_of_split_logs_say_what_whole_texts_say(spark, tmp_path):
    rng = random.Random(8)
    parts = ["zUMIs version 2.%d ", "web_summary:  /w/%d", "Run summary HTML: /h/%d", "noise %d", "", "x zUMIs version", "é %d\r"]
    for log in range(12):
        lines = [rng.choice(parts[3 if log == 0 else 0 :]).replace("%d", str(k)) for k in range(700)]
        if log % 3 == 1:
            lines[rng.randrange(700)] = "Pipestance completed successfully!"
        (tmp_path / f"{log}.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = R.read_log_lines(spark, str(tmp_path))
        assert rows.select("path", "place.block").distinct().count() > 60
        found = {r.path: (r.succeeded, r.report_path, r.version) for r in rows.groupBy("path").agg(*T.log_facts()).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = R.read_logs(spark, str(tmp_path)).select(
        "path", T.run_succeeded("text"), T.report_path("text"), T.tool_version("text")
    )
    assert found == {r[0]: tuple(r[1:]) for r in whole.collect()}
    assert len({version for _, _, version in found.values()}) > 3
