"""Declared schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

# --------------------------------------------------------------------------
# Status words and their classes.
# --------------------------------------------------------------------------

# Classes used when a project's status is rolled up from its samples.
ROLLUP_ACTIVE = (
    "initialized",
    "processing",
    "pre_processing",
    "post_processing",
    "requires_manual_submission",
)
ROLLUP_FINISHED = ("completed", "aborted")
ROLLUP_NOT_STARTED = ("pending", "unsequenced")

# Classes used when a status change stamps a sample's start or end time.
STAMPS_START = ("processing", "running", "pre_processing", "post_processing")
STAMPS_END = (
    "completed",
    "pre_processing_failed",
    "processing_failed",
    "post_processing_failed",
    "aborted",
)

# Project statuses that set or clear the end date.
SETS_END_DATE = ("completed", "partially_completed")
CLEARS_END_DATE = ("processing", "failed", "ongoing")

# Samples that are left out of a run, and samples whose job is followed.
NOT_PROCESSABLE = ("aborted", "unsequenced", "completed")
MONITORED = ("auto-submitted", "manually_submitted", "processing")

# Scheduler end states; everything but the first is a failure.
JOB_SUCCESS_STATE = "COMPLETED"
JOB_END_STATES = (
    "COMPLETED",
    "FAILED",
    "CANCELLED",
    "CANCELLED+",
    "TIMEOUT",
    "OUT_OF_ME+",
)

EVENT_TYPES = ("project_change", "flowcell_ready", "delivery_ready")

# --------------------------------------------------------------------------
# Keys, method fragments, log texts, marks and sizes.
# --------------------------------------------------------------------------

REPORT_KEYS = (
    "file_name",
    "date_created",
    "signee",
    "date_signed",
    "rejected",
    "samples_included",
)

# What follows the project's name in the name of its report.
REPORT_SUFFIX = "_project_summary.html"

# Method text fragments that decide the default feature of a sample.
GEX_METHOD_PATTERNS = ("3' GEX", "5' GEX", "3GEX", "5GEX", "VDJ")
ATAC_METHOD_PATTERN = "ATAC"

# Run log texts.
RUN_SUCCESS_MARKER = "Pipestance completed successfully!"
REPORT_PATH_PATTERNS = (r"Run summary HTML:\s+(\S+)", r"web_summary:\s+(\S+)")
TOOL_VERSION_PHRASE = "zUMIs version"
TOOL_VERSION_DEFAULT = "--"

# Genome text that stands for "not given".
UNSPECIFIED_GENOME = "Other (-, -)"

FASTQ_ROLES = ("R1", "R2", "I1", "I2")
FASTQ_SUFFIXES = (".fastq.gz", ".fq.gz")

# A plate is 16 rows (A-P) by 24 columns.
PLATE_ROWS = 16
PLATE_COLUMNS = 24
PLATE_WELLS = PLATE_ROWS * PLATE_COLUMNS

NULL_SHARE_LIMIT = 10.0
SIZE_RANGE = (10.0, 200.0)

# --------------------------------------------------------------------------
# Schemas, as Spark DDL.
# --------------------------------------------------------------------------

RAW_DOC = "doc_id STRING, seq BIGINT, body STRING"

PROJECT_DOC = """
_id STRING, project_id STRING, project_name STRING, reference_genome STRING,
contact STRING, customer_project_reference STRING,
details STRUCT<library_construction_method: STRING, library_prep_option: STRING,
  organism: STRING, sequencing_setup: STRING, sensitive_data: STRING,
  library_prep_option_single_cell_hashing: STRING,
  library_prep_option_single_cell_cite: STRING,
  library_prep_option_single_cell_vdj: STRING,
  library_prep_option_single_cell_feature: STRING>,
order_details STRUCT<owner: STRUCT<email: STRING, name: STRING>,
  fields: MAP<STRING, STRING>>,
samples MAP<STRING, STRUCT<customer_name: STRING, sample_id: STRING,
  details: MAP<STRING, STRING>,
  library_prep: MAP<STRING, STRUCT<barcode: STRING, sequenced_fc: ARRAY<STRING>>>>>
"""

LONG_STATS = {
    "readspercell": "RG STRING, N BIGINT, type STRING",
    "genecounts": "SampleID STRING, Count BIGINT, type STRING",
    "bc_umi_stats": "XC STRING, nUMItag BIGINT, nNontagged BIGINT",
}

BARCODE_LOOKUP = "BCset STRING, WellID STRING, XC STRING, XC_NovaSeq STRING"

# Reagent version -> barcode column; any other version reads the first one.
REAGENT_COLUMN = {"1.5": "XC", "1.0": "XC_NovaSeq"}

COUNT_MATRIX = "plate STRING, cell STRING, gene STRING, count BIGINT"
