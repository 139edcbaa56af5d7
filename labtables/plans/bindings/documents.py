"""Project documents: building, parsing, checking; names and log texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables import schemas
from labtables.functions import documents as D
from labtables.functions import text as T
from labtables.operators.routing import Rule
from labtables.operators.samples import explode_samples
from labtables.plans.bindings._registry import query, table
from labtables.plans.intake import intake_projects, intake_samples, missing_paths
from labtables.plans.one_off import run_once
from labtables.sources.readers import existing_docs, lookup_doc, parse_docs, typed


def _text(column: str, prefix: str = "") -> Column:
    value = F.col(column).cast("string")
    return F.concat(F.lit(prefix), value) if prefix else value


def raw_docs(customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Customers (with their nation) as project documents: seq, doc_id, body.

    Every third has no prep option and so is in the new format; every fifth
    lacks its organism and every seventh its contact; every eleventh has a
    null contact instead.
    """
    key = F.col("c_custkey")
    details = F.struct(
        F.col("c_mktsegment").alias("library_construction_method"),
        F.when(key % 3 != 0, F.lit("Dual")).alias("library_prep_option"),
        F.when(key % 5 != 0, F.lower("n_name")).alias("organism"),
        F.lit("151-8-8-151").alias("sequencing_setup"),
        F.when(key % 4 == 0, F.lit("Yes")).when(key % 4 == 1, F.lit("no")).alias("sensitive_data"),
        F.when(key % 2 == 0, F.lit("tags")).alias("library_prep_option_single_cell_hashing"),
    )
    fields = F.struct(
        F.when(key % 2 == 0, _text("c_custkey", "pi")).alias("project_pi_email"),
        F.lit("The PI").alias("project_pi_name"),
        _text("c_nationkey", "lab").alias("project_lab_email"),
        F.lit("The Lab").alias("project_lab_name"),
    )
    owner = F.struct(_text("c_name").alias("name"), _text("c_custkey", "own").alias("email"))
    prep = F.struct(
        F.lit("X-7").alias("barcode"),
        F.when(key % 6 != 0, F.array(F.concat(F.lit("20240101_"), _text("c_custkey")), F.lit("231231_A"))).alias(
            "sequenced_fc"
        ),
    )

    def sample(manual: Column) -> Column:
        return F.struct(
            F.lit("n_GE").alias("customer_name"),
            F.struct(manual.alias("status_(manual)")).alias("details"),
            F.struct(prep.alias("A")).alias("library_prep"),
        )

    samples = F.struct(
        sample(F.lit("ok")).alias("S1"),
        sample(F.when(key % 2 == 0, F.lit("Aborted"))).alias("S2"),
    )
    body = F.to_json(
        F.struct(
            _text("c_custkey").alias("_id"),
            _text("c_custkey", "P").alias("project_id"),
            F.col("c_name").alias("project_name"),
            F.concat(F.initcap("n_name"), F.lit(" (Latin, v1)")).alias("reference_genome"),
            F.when(key % 7 != 0, _text("c_custkey", "c")).alias("contact"),
            details.alias("details"),
            F.struct(owner.alias("owner"), fields.alias("fields")).alias("order_details"),
            samples.alias("samples"),
        )
    )
    # An explicit null, which to_json leaves out.
    opening = F.when(
        (key % 7 == 0) & (key % 11 == 0), F.lit('{"contact":null,')
    ).otherwise(F.lit("{"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("seq"),
        _text("c_custkey").alias("doc_id"),
        F.concat(opening, F.substr(body, F.lit(2))).alias("body"),
    )


def project_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_docs(raw_docs(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")))


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS project_name, 'P' || CAST(c_custkey AS VARCHAR) AS project_id,
      '' AS customer_reference, c_mktsegment AS library_prep_method,
      CASE WHEN c_custkey % 3 <> 0 THEN 'Dual' ELSE '' END AS library_prep_option,
      upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' (Latin, v1)' AS reference_genome,
      CASE WHEN c_custkey % 5 <> 0 THEN lower(n_name) ELSE '' END AS organism,
      CASE WHEN c_custkey % 7 <> 0 THEN 'c' || CAST(c_custkey AS VARCHAR) ELSE '' END AS contact,
      CASE WHEN c_custkey % 3 <> 0 THEN 'old_format' ELSE 'new_format' END AS case_type,
      CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'tags' ELSE 'None' END END AS hashing,
      CASE WHEN c_custkey % 3 = 0 THEN 'None' END AS cite, CASE WHEN c_custkey % 3 = 0 THEN 'None' END AS vdj,
      CASE WHEN c_custkey % 3 = 0 THEN 'None' END AS feature
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """
)
def project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.project_info(typed(project_docs(spark, sf_dir), "doc_id"), "doc_id")


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS project_name, 'P' || CAST(c_custkey AS VARCHAR) AS project_id,
      CAST(NULL AS VARCHAR) AS customer_id, CASE WHEN c_custkey % 3 <> 0 THEN 'Dual' END AS library_prep_option,
      CASE WHEN c_custkey % 7 <> 0 THEN 'c' || CAST(c_custkey AS VARCHAR) END AS contact,
      upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' (Latin, v1)' AS ref_genome,
      CASE WHEN c_custkey % 5 <> 0 THEN lower(n_name) END AS organism, '151-8-8-151' AS sequencing_setup
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """
)
def plate_project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.plate_project_info(typed(project_docs(spark, sf_dir), "doc_id"), "doc_id")


@query(
    """
    WITH r(role) AS (VALUES ('owner'), ('bioinformatician'), ('pi'), ('lab'))
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, role,
      CASE role WHEN 'owner' THEN 'own' || CAST(c_custkey AS VARCHAR)
        WHEN 'pi' THEN CASE WHEN c_custkey % 2 = 0 THEN 'pi' || CAST(c_custkey AS VARCHAR) ELSE '' END
        WHEN 'lab' THEN 'lab' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS email,
      CASE role WHEN 'owner' THEN c_name WHEN 'pi' THEN 'The PI' WHEN 'lab' THEN 'The Lab' ELSE '' END AS name,
      c_custkey % 4 = 0 AS sensitive
    FROM customer, r
    """
)
def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(project_docs(spark, sf_dir), "doc_id")
    info = D.user_info("order_details.owner", "order_details.fields")
    rows = docs.select(
        "doc_id", D.is_sensitive("details.sensitive_data").alias("sensitive"), F.explode(info).alias("role", "who")
    )
    return rows.select("doc_id", "role", "who.email", "who.name", "sensitive")


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id,
      CASE WHEN c_custkey % 2 = 0 THEN 'pi' || CAST(c_custkey AS VARCHAR) ELSE '' END AS pi_email,
      'own' || CAST(c_custkey AS VARCHAR) AS contact_email, '' AS bioinfo_email,
      CASE WHEN c_custkey % 3 = 0 THEN true ELSE c_custkey % 4 = 0 END AS deliver_sensitive
    FROM customer
    """
)
def contact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts for a delivery; the sensitive flag is unset for every third."""
    docs = typed(project_docs(spark, sf_dir), "doc_id")
    docs = docs.withColumn("info", D.user_info("order_details.owner", "order_details.fields"))
    flag = F.when(
        F.col("doc_id").cast("long") % 3 != 0, D.is_sensitive("details.sensitive_data")
    )
    return docs.select(
        "doc_id",
        D.contact_email("info", "pi").alias("pi_email"),
        D.contact_email("info", "owner").alias("contact_email"),
        D.contact_email("info", "bioinformatician").alias("bioinfo_email"),
        D.delivery_sensitive(flag).alias("deliver_sensitive"),
    )


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def lookup_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id, which is what this operator is."""
    docs = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return lookup_doc(docs, 42, key="c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def existing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return existing_docs(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


REQUIRED = ["project_id", "contact", "details.organism", "details.sensitive_data"]

MISSING_SQL = """concat_ws(',',
      CASE WHEN c_custkey % 7 = 0 AND c_custkey % 11 <> 0 THEN 'contact' END,
      CASE WHEN c_custkey % 5 = 0 THEN 'details.organism' END,
      CASE WHEN c_custkey % 4 > 1 THEN 'details.sensitive_data' END)"""


@query(
    f"""
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, {MISSING_SQL} AS missing, {MISSING_SQL} = '' AS complete FROM customer
    """
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = D.missing_fields("variant", REQUIRED)
    return project_docs(spark, sf_dir).select(
        "doc_id",
        F.array_join(missing, ",").alias("missing"),
        (F.size(missing) == 0).alias("complete"),
    )


@query(
    f"""
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, concat_ws(',', nullif({MISSING_SQL}, ''),
      CASE WHEN c_custkey % 6 = 0 THEN 'samples.S1.library_prep.A.sequenced_fc' END,
      CASE WHEN c_custkey % 6 = 0 THEN 'samples.S2.library_prep.A.sequenced_fc' END,
      CASE WHEN c_custkey % 2 <> 0 THEN 'samples.S2.details.status_(manual)' END) AS missing
    FROM customer
    """
)
def missing_sample_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document and each of its samples lacks."""
    wanted = ["library_prep.A.sequenced_fc", "details.status_(manual)"]
    return project_docs(spark, sf_dir).select(
        "doc_id", F.array_join(missing_paths("variant", REQUIRED, wanted), ",").alias("missing")
    )


@query(
    """
    SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS valid FROM orders
    """
)
def valid_report_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report entries need all their keys; a null value is a present key."""
    key = F.col("o_orderkey")
    parts = [
        F.concat(F.lit('"file_name":"r'), key.cast("string"), F.lit('"')),
        F.lit('"date_created":"2025-01-01","date_signed":""'),
        F.when(key % 3 != 0, F.when(key % 2 == 0, F.lit('"signee":null')).otherwise(F.lit('"signee":"me"'))),
        F.when(key % 5 != 0, F.lit('"rejected":false')),
        F.lit('"samples_included":[]'),
    ]
    entry = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return table(spark, sf_dir, "orders").select(
        key, D.has_keys(F.parse_json(entry), schemas.REPORT_KEYS).alias("valid")
    )


RULES = [
    Rule("MACHINERY", "exact_machinery"),
    Rule("AUTO", "auto_realm", prefix=True),
    Rule("BUILD", "build_realm", prefix=True),
]

TARGET_SQL = """CASE WHEN c_mktsegment = 'MACHINERY' THEN 'exact_machinery'
    WHEN c_mktsegment LIKE 'AUTO%' THEN 'auto_realm' WHEN c_mktsegment LIKE 'BUILD%' THEN 'build_realm' END"""


@query(
    f"""
    WITH t AS (SELECT user_id, arg_max(event_type, event_id) IN ('click', 'view') AS done FROM events
               GROUP BY user_id),
    r AS (SELECT c_custkey, c_mktsegment, {TARGET_SQL} AS target
      FROM customer WHERE {MISSING_SQL} = '' AND c_custkey % 6 <> 0)
    SELECT 'P' || CAST(c_custkey AS VARCHAR) AS project_id, target,
      CASE WHEN user_id IS NULL THEN 'insert' WHEN done THEN 'skip' ELSE 'sync' END AS action,
      NOT (user_id IS NOT NULL AND done) AS proceed
    FROM r LEFT JOIN t ON c_custkey = user_id WHERE target IS NOT NULL
    """
)
def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake_projects(
        project_docs(spark, sf_dir), RULES, REQUIRED, _tracking(spark, sf_dir), ["customer_name", "library_prep.A.sequenced_fc"]
    )
    return rows.select("project_id", "target", "action", "proceed")


def _tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with events as tracked projects, completed by their last one."""
    done = F.max_by("event_type", "event_id").isin("click", "view")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.when(done, F.lit("completed")).otherwise(F.lit("processing")).alias("project_status"))
        .select(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("project_id"), "project_status")
    )


@query(
    f"""
    SELECT 'P' || CAST(c_custkey AS VARCHAR) AS project_id, {TARGET_SQL} AS target
    FROM customer WHERE c_custkey = 77 AND {MISSING_SQL} = '' AND {TARGET_SQL} IS NOT NULL
    """
)
def one_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake of one document by id, which is what this job is."""
    rows = run_once(project_docs(spark, sf_dir), "77", RULES, REQUIRED, _tracking(spark, sf_dir))
    return rows.select("project_id", "target")


@query(
    """
    SELECT 'P' || CAST(c_custkey AS VARCHAR) AS project_id, s AS sample_id,
      CASE WHEN c_custkey % 6 <> 0 THEN '20240101_' || CAST(c_custkey AS VARCHAR) END AS flowcell,
      CASE WHEN c_custkey % 6 <> 0 THEN 'initialized' ELSE 'unsequenced' END AS status
    FROM customer, (VALUES ('S1'), ('S2')) AS t(s) WHERE s = 'S1' OR c_custkey % 2 <> 0
    """
)
def intake_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake_samples(project_docs(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, s AS sample_id, '7' AS barcode FROM customer, (VALUES ('S1'), ('S2')) AS t(s)")
def sample_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(project_docs(spark, sf_dir), "doc_id")
    return explode_samples(docs, "samples", "doc_id").select(
        "doc_id", "sample_id", T.sample_barcode("sample.library_prep").alias("barcode")
    )


@query(
    """
    SELECT page_id, list_extract(string_split(url, '-'), -1) AS barcode FROM pages
    """
)
def barcode_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep = F.create_map(F.lit("A"), F.struct(F.col("url").alias("barcode")))
    return table(spark, sf_dir, "pages").select("page_id", T.sample_barcode(prep).alias("barcode"))


@query(
    """
    SELECT p_partkey,
      CASE WHEN p_partkey % 4 <> 0 THEN 'cDNA(23-' || CAST(p_size AS VARCHAR) || ')' END AS r1_cdna,
      CASE WHEN p_partkey % 4 <> 0 THEN 'UMI(12-19)' END AS r1_umi,
      CASE WHEN p_partkey % 4 <> 0 THEN 'cDNA(1-' || CAST(p_partkey AS VARCHAR) || ')' END AS r2,
      CASE WHEN p_partkey % 4 <> 0 THEN 'BC(1-8)' END AS i1, CASE WHEN p_partkey % 4 <> 0 THEN 'BC(1-10)' END AS i2
    FROM part
    """
)
def read_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat_ws("-", _text("p_size"), F.lit("8"), F.lit("10"), _text("p_partkey"))
    setup = F.when(F.col("p_partkey") % 4 != 0, full).otherwise(F.concat_ws("-", _text("p_size"), F.lit("8")))
    rows = table(spark, sf_dir, "part").select("p_partkey", T.read_layout(setup).alias("layout"))
    return rows.select("p_partkey", "layout.*")


GENOME_SQL = """CASE p_partkey % 6 WHEN 0 THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' (' || p_name || ', v1)'
    WHEN 1 THEN 'Other (-, -)' WHEN 2 THEN '' WHEN 3 THEN p_type || ' no name' WHEN 4 THEN NULL ELSE 'X (other, -)' END"""


def _genome() -> Column:
    kind = F.col("p_partkey") % 6
    return (
        F.when(kind == 0, F.concat(F.initcap("p_type"), F.lit(" ("), F.col("p_name"), F.lit(", v1)")))
        .when(kind == 1, F.lit("Other (-, -)"))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.concat(F.col("p_type"), F.lit(" no name")))
        .when(kind == 5, F.lit("X (other, -)"))
    )


@query(
    f"""
    SELECT p_partkey, {GENOME_SQL} AS genome,
      CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 3 THEN NULL ELSE lower(p_brand) END AS species
    FROM part
    """
)
def species_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("genome", _genome())
    return parts.select("p_partkey", "genome", T.species_key("genome", "p_brand").alias("species"))


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 AND p_type IN ('PROMO', 'SMALL') THEN lower(p_type)
      WHEN lower(p_brand) IN ('brand#2', 'brand#17') THEN lower(p_brand) END AS organism
    FROM part
    """
)
def organism_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    supported = ["promo", "small", "brand#2", "brand#17"]
    parts = table(spark, sf_dir, "part").withColumn("genome", _genome())
    return parts.select("p_partkey", T.organism_common("genome", "p_brand", supported).alias("organism"))


@query(
    """
    WITH s AS (SELECT p_partkey, p_partkey % 2 = 0 AS old, CAST(p_partkey AS VARCHAR) AS id,
        replace(p_name, ' ', '_') AS name, CASE WHEN p_size < 20 THEN '3GEX kit' WHEN p_size < 40 THEN 'ATAC' ELSE 'x' END AS m
      FROM part),
    c AS (SELECT *, CASE WHEN m = '3GEX kit' THEN 'gex' WHEN m = 'ATAC' THEN 'atac' ELSE 'unknown' END AS dflt,
        CASE WHEN old THEN CASE WHEN name LIKE '%\\_wid%' ESCAPE '\\' THEN 'w' WHEN name LIKE '%\\_ri%' ESCAPE '\\' THEN 'r' END
             ELSE CASE right(id, 1) WHEN '1' THEN 'one' WHEN '3' THEN 'three' END END AS f FROM s)
    SELECT p_partkey, coalesce(f, dflt) AS feature,
      CASE WHEN f IS NULL THEN id WHEN f = 'w' THEN string_split(name, '_wid')[1] WHEN f = 'r' THEN string_split(name, '_ri')[1]
           WHEN length(id) > 1 THEN left(id, length(id) - 1) ELSE 'unknown_sample_id' END AS origin
    FROM c
    """
)
def feature_and_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = (
        F.when(F.col("p_size") < 20, F.lit("3GEX kit")).when(F.col("p_size") < 40, F.lit("ATAC")).otherwise(F.lit("x"))
    )
    result = T.feature_and_origin(
        F.when(F.col("p_partkey") % 2 == 0, F.lit("old_format")).otherwise(F.lit("new_format")),
        _text("p_partkey"),
        F.replace("p_name", F.lit(" "), F.lit("_")),
        method,
        method,
        [("wid", "w"), ("ri", "r")],
        {"1": "one", "3": "three"},
    )
    return table(spark, sf_dir, "part").select("p_partkey", result.alias("r")).select("p_partkey", "r.feature", "r.origin")


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN NULL
        ELSE CASE p_partkey % 5 WHEN 0 THEN 'R1' WHEN 1 THEN 'R2' WHEN 2 THEN 'I1' WHEN 3 THEN 'I2' END END AS role
    FROM part
    """
)
def fastq_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    mark = F.element_at(F.array(*[F.lit(m) for m in ("R1", "R2", "I1", "I2", "X1")]), (key % 5 + 1).cast("int"))
    suffix = F.when(key % 7 == 6, F.lit(".fastq.gz.md5")).when(key % 2 == 0, F.lit(".fastq.gz")).otherwise(F.lit(".fq.gz"))
    path = F.concat(F.lit("/data_R2_/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_S1_"), mark, F.lit("_001"), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", T.fastq_role(path).alias("role"))


@query(
    """
    SELECT doc_id, contains(text, 'License') AS succeeded,
      coalesce(nullif(regexp_extract(text, 'Released under the\\s+(\\S+)', 1), ''),
               nullif(regexp_extract(text, 'the\\s+(\\S+)', 1), '')) AS report_path
    FROM documents
    """
)
def log_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = (r"Released under the\s+(\S+)", r"the\s+(\S+)")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.run_succeeded("text", "License").alias("succeeded"),
        T.report_path("text", patterns).alias("report_path"),
    )


@query(
    """
    WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line
        FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    b AS (SELECT doc_id, arg_max(line, i) AS line FROM l WHERE contains(line, 'the') GROUP BY doc_id)
    SELECT d.doc_id, coalesce(regexp_extract(b.line, '(\\S+)\\s*$', 1), '--') AS version
    FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id
    """
)
def tool_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.tool_version("text", phrase="the").alias("version")
    )
