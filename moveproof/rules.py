"""Thresholds, weights, labels and lookup tables of the rule set."""

# --- fixed values: severities -------------------------------------------------
HIGH, MEDIUM, LOW, CRITICAL = "HIGH", "MEDIUM", "LOW", "CRITICAL"

# lower bound (inclusive) -> label; first match wins, then the default
DUPLICATE_SEVERITY = ([(10, HIGH)], MEDIUM)
NULL_SEVERITY = ([(80, HIGH), (30, MEDIUM)], LOW)
OPTIONAL_SILENT_FROM = 95
REQUIRED_SEMANTICS = ("required", "conditionally_required", "primary_key", "business_key")

# row match percentage: below 90 HIGH, below 99 MEDIUM, else LOW
ROW_MATCH_SEVERITY = ([(99, LOW), (90, MEDIUM)], HIGH)
MINOR_COLUMN_DIFFERENCE = 2

# --- fixed values: assessment -------------------------------------------------
ISSUE_WEIGHTS = {"high": 10, "medium": 5, "low": 2}
GROWTH_RISK = [(50, 15, HIGH), (20, 10, HIGH), (10, 5, MEDIUM)]
LONG_RETENTION_DAYS, MID_RETENTION_DAYS = 2555, 1095
STRICT_DURATION_MIN, CONTROLLED_DURATION_MIN = 30, 120
STRICT_DOWNTIME_MIN, CONTROLLED_DOWNTIME_MIN = 5, 30
RISK_LEVEL = ([(50, CRITICAL), (25, HIGH), (10, MEDIUM)], LOW)

VOLUME_SCORE = ([(10_000_000, 30), (1_000_000, 20), (100_000, 10)], 5)
DATASET_SCORE = ([(100, 25), (50, 20), (20, 15), (10, 10)], 5)
WIDTH_SCORE = ([(1000, 20), (500, 15), (200, 10)], 5)
GROWTH_SCORE = ([(50, 15), (20, 10), (10, 5)], 0)
COMPLEXITY_LEVEL = ([(70, "VERY_HIGH"), (45, HIGH), (20, MEDIUM)], LOW)

RISK_PENALTY = {"LOW": 0, "MEDIUM": 5, "HIGH": 10, "CRITICAL": 15}
COMPLEXITY_PENALTY = {"LOW": 0, "MEDIUM": 3, "HIGH": 6, "VERY_HIGH": 10}
READINESS_LEVEL = (
    [(85, "READY"), (65, "READY_WITH_CONDITIONS"), (40, "NEEDS_REMEDIATION")],
    "NOT_READY",
)
NOT_EXECUTED = "NOT_EXECUTED_DATABASE_REQUIRED"

# --- fixed values: recommendations --------------------------------------------
PRIORITY_ORDER = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}

# source, issue type, id prefix, category, title
RECOMMENDATION_RULES = [
    ("PROFILING", "NULL_VALUES", "PROF", "DATA_QUALITY", "Review Missing Data"),
    ("PROFILING", "DUPLICATE_ROWS", "PROF", "DATA_QUALITY", "Resolve Duplicate Records"),
    ("PROFILING", "EMPTY_DATASET", "PROF", "DATA_AVAILABILITY", "Investigate Empty Dataset"),
    ("PROFILING", "CONSTANT_COLUMN", "PROF", "DATA_QUALITY", "Review Constant Field"),
    ("RECONCILIATION", "ROW_COUNT_MISMATCH", "RECON", "DATA_RECONCILIATION",
     "Resolve Record Count Mismatch"),
    ("RECONCILIATION", "COLUMN_COUNT_MISMATCH", "RECON", "SCHEMA_RECONCILIATION",
     "Resolve Schema Mismatch"),
    ("RECONCILIATION", "MISSING_TARGET_DATASET", "RECON", "MIGRATION_COMPLETENESS",
     "Load Missing Target Dataset"),
]

# findings the standard table leaves without advice; used only on request
EXTENDED_RECOMMENDATION_RULES = [
    ("PROFILING", "PRIMARY_KEY_NULL", "PROF", "DATA_QUALITY", "Fill Missing Key Values"),
    ("PROFILING", "PRIMARY_KEY_DUPLICATE", "PROF", "DATA_QUALITY", "Resolve Repeated Keys"),
    ("PROFILING", "PRIMARY_KEY_MISSING_COLUMNS", "PROF", "DATA_QUALITY", "Restore Key Columns"),
    ("PROFILING", "NULL_VALUES_OPTIONAL", "PROF", "DATA_QUALITY", "Confirm Optional Gaps"),
    ("RECONCILIATION", "COLUMN_COUNT_MISMATCH_MINOR", "RECON", "SCHEMA_RECONCILIATION",
     "Confirm Small Schema Difference"),
    ("RECONCILIATION", "EXTRA_TARGET_DATASET", "RECON", "MIGRATION_SCOPE",
     "Review Extra Target Dataset"),
    ("FOREIGN_KEY", "FOREIGN_KEY_ORPHAN", "RECON", "DATA_RECONCILIATION",
     "Resolve Orphan Records"),
]

# condition column, levels, id, category, fixed priority (None: the level itself), title
STRATEGIC_RULES = [
    ("risk_level", ("HIGH", "CRITICAL"), "STRAT-001", "MIGRATION_RISK", None,
     "Reduce Migration Risk"),
    ("complexity_level", ("HIGH", "VERY_HIGH"), "STRAT-002", "MIGRATION_COMPLEXITY", "HIGH",
     "Apply Enhanced Migration Controls"),
    ("readiness_level", ("READY",), "STRAT-003", "MIGRATION_READINESS", "LOW",
     "Proceed to Next Migration Stage"),
    ("readiness_level", ("READY_WITH_CONDITIONS",), "STRAT-003", "MIGRATION_READINESS", "MEDIUM",
     "Proceed with Defined Conditions"),
    ("readiness_level", ("NEEDS_REMEDIATION", "NOT_READY"), "STRAT-003", "MIGRATION_READINESS",
     "HIGH", "Complete Remediation Before Approval"),
]

DEFAULT_OWNER = "MIGRATION_TEAM"
OWNERS = {
    "DATA_QUALITY": "DATA_OWNER",
    "DATA_AVAILABILITY": "SOURCE_SYSTEM_OWNER",
    "DATA_RECONCILIATION": "MIGRATION_ENGINEER",
    "SCHEMA_RECONCILIATION": "DATABASE_ENGINEER",
    "MIGRATION_COMPLETENESS": "MIGRATION_ENGINEER",
    "MIGRATION_SCOPE": "MIGRATION_MANAGER",
    "MIGRATION_RISK": "MIGRATION_MANAGER",
    "MIGRATION_COMPLEXITY": "TECHNICAL_LEAD",
    "MIGRATION_READINESS": "MIGRATION_MANAGER",
}
BLOCKING_CATEGORIES = ("MIGRATION_COMPLETENESS", "SCHEMA_RECONCILIATION")

# --- fixed values: names and types --------------------------------------------
CHARACTER_REPLACEMENTS = [(" ", "_"), ("-", "_"), (".", "_"), ("@", "_"), ("#", "_"), ("*", "")]

DEFAULT_LOGICAL_TYPE = "TEXT"
PHYSICAL_TYPES = {
    "MYSQL": {
        "INTEGER": "INT", "BIGINT": "BIGINT", "NUMERIC": "DECIMAL(18,4)", "TEXT": "TEXT",
        "VARCHAR": "VARCHAR(255)", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP",
        "BOOLEAN": "BOOLEAN",
    },
    "POSTGRESQL": {
        "INTEGER": "INTEGER", "BIGINT": "BIGINT", "NUMERIC": "NUMERIC", "TEXT": "TEXT",
        "VARCHAR": "VARCHAR(255)", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP",
        "BOOLEAN": "BOOLEAN",
    },
    "MSSQL": {
        "INTEGER": "INT", "BIGINT": "BIGINT", "NUMERIC": "DECIMAL(18,4)",
        "TEXT": "NVARCHAR(MAX)", "VARCHAR": "NVARCHAR(255)", "DATE": "DATE",
        "TIMESTAMP": "DATETIME2", "BOOLEAN": "BIT",
    },
}

# name hints used when a table is created without a type registry
NAME_HINTS = [
    (("id", "customerid", "userid", "orderid", "productid", "sellerid"), "INT", True),
    (("email", "firstname", "lastname", "city", "state", "name"), "VARCHAR(255)", False),
    (("joindate", "createddate", "modifieddate"), "DATETIME", False),
    (("salary", "price", "amount", "total"), "DECIMAL(10,2)", False),
    (("phone",), "VARCHAR(20)", False),
]
NAME_HINT_DEFAULT = "VARCHAR(255)"

# null spellings a typed CSV read recognises (pandas defaults)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# tables that schema-change tools keep in every database they manage; no user data
SYSTEM_TABLES = ("databasechangelog", "databasechangeloglock")
