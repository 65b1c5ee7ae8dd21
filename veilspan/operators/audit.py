"""Risk, compliance and trust of redaction requests, as columns; the audit log as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH = ("BANK_ACCOUNT", "CREDIT_CARD", "HEALTH_PLAN_ID", "MEDICAL_RECORD", "PASSPORT", "SSN")
RETENTION = {"PUBLIC": 365, "INTERNAL": 1095, "SENSITIVE": 2555, "RESTRICTED": 2555, "SECURITY": 2555, "SYSTEM": 365}


def _any(types: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, names))), F.lit(False))


def risk(found: Column, types: Column) -> Column:
    return F.when(_any(types, HIGH), "HIGH").when(found > 10, "MEDIUM").when(found > 0, "LOW").otherwise("MINIMAL")


def retention_days(data_class: Column, default: int = 2555) -> Column:
    out = F.lit(default)
    for name, days in RETENTION.items():
        out = F.when(data_class == name, days).otherwise(out)
    return out


def context(operation: Column, types: Column) -> Column:
    """What each standard asks of an event."""
    yes, no = F.lit(True), F.lit(False)
    return F.struct(
        F.struct(yes.alias("lawful_basis_required"), yes.alias("data_subject_rights_applicable"), _any(types, ("BIOMETRIC_DATA", "GENETIC_DATA", "HEALTH_DATA")).alias("special_category_data"), no.alias("cross_border_transfer")).alias("gdpr"),
        F.struct(_any(types, ("HEALTH_PLAN_ID", "MEDICAL_RECORD", "PATIENT_ID")).alias("phi_processed"), yes.alias("minimum_necessary_standard"), (operation == "redaction").alias("safe_harbor_method")).alias("hipaa"),
        F.struct(_any(types, ("CREDIT_CARD",)).alias("cardholder_data"), yes.alias("encryption_required"), yes.alias("access_logged")).alias("pci_dss"),
    )


def _told(*notes: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(cond, F.lit(text)) for cond, text in notes)), lambda x: x.isNotNull())


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def validated(requests: DataFrame) -> DataFrame:
    """violations, recommendations, required_actions and compliant for requests with entity_types, lawful_basis,
    consent_obtained, processing_purpose, authorized_user, minimum_necessary_justified, secure_environment, access_controls_verified."""
    basis, purpose = F.coalesce("lawful_basis", F.lit("")), F.coalesce("processing_purpose", F.lit(""))
    phi, card = _any(F.col("entity_types"), ("DEA_NUMBER", "HEALTH_PLAN_ID", "MEDICAL_RECORD", "PATIENT_ID")), _any(F.col("entity_types"), ("CREDIT_CARD",))
    no_basis, no_consent = basis == "", (basis == "consent") & ~_flag("consent_obtained")
    no_user, no_room = phi & ~_flag("authorized_user"), card & ~_flag("secure_environment")
    out = requests.withColumns({
        "violations": _told((no_basis, "GDPR: no lawful basis given"), (no_consent, "GDPR: no valid consent"), (no_user, "HIPAA: PHI without authorization"), (no_room, "PCI DSS: card data outside a secure environment")),
        "recommendations": _told((purpose == "", "GDPR: state the purpose"), (F.lit(True), "GDPR: process only what is needed"), (phi & ~_flag("minimum_necessary_justified"), "HIPAA: justify the minimum necessary"), (card & ~_flag("access_controls_verified"), "PCI DSS: verify access controls")),
        "required_actions": _told((no_basis, "name the lawful basis (Article 6)"), (no_consent, "obtain explicit consent"), (no_user, "verify authorization for PHI"), (no_room, "move to a compliant environment")),
    })
    return out.withColumn("compliant", F.size("violations") == 0)


def trusted(requests: DataFrame) -> DataFrame:
    """Six scores of 0 to 10, their sum as a percentage, whether that is at least 70, and what to do."""
    pts = lambda **flags: sum((F.when(_flag(k), v).otherwise(0) for k, v in flags.items()), F.lit(0))
    network = F.when(_flag("internal_network"), 4).when(_flag("vpn_connection"), 3).otherwise(0) + pts(geo_location_verified=3, known_ip_address=3)
    data = F.when(F.col("data_classification") == "PUBLIC", 10).when(F.col("data_classification") == "INTERNAL", 8).when(F.col("data_classification") == "SENSITIVE", 6).when(F.col("data_classification") == "RESTRICTED", 4).otherwise(0)
    out = requests.withColumns({
        "user_identity": pts(user_authenticated=3, mfa_verified=4, certificate_based_auth=3), "device_security": pts(device_managed=3, device_encrypted=2, antivirus_updated=2, os_patched=3),
        "network_location": network, "data_handling": data, "request_context": pts(business_hours=3, authorized_application=4, rate_limit_compliant=3),
        "behaviour": F.greatest(F.lit(0), 5 - pts(unusual_access_pattern=3, suspicious_volume=2, anomalous_timing=2)),
    })
    total = sum((F.col(c) for c in ("user_identity", "device_security", "network_location", "data_handling", "request_context", "behaviour")), F.lit(0))
    out = out.withColumn("trust_score", total / 60.0 * 100)
    return out.withColumns({
        "trusted": F.col("trust_score") >= 70,
        "advice": _told((F.col("trust_score") < 50, "deny"), (F.col("trust_score").between(50, 69.999999), "ask for more proof"), (F.col("user_identity") < 7, "strengthen authentication"), (F.col("device_security") < 6, "secure the device"), (F.col("network_location") < 5, "use a secure network")),
    })


def append_log(events: DataFrame, path: str) -> None:
    """Append events (with a timestamp) as JSON, a folder a day."""
    events.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)


#: Fields of an event; ``day`` is its folder.
EVENT = """timestamp string, event_id string, event_type string, user_id string, session_id string, operation string, resource string, details map<string,string>,
compliance_context string, risk_level string, data_classification string, retention_period int, day date"""


def query_log(spark, path: str, start: str | None = None, end: str | None = None, schema: str = EVENT, **equal: str) -> DataFrame:
    """Events between two times (both included) with the given field values; a range of days reads only their folders."""
    log = spark.read.schema(schema).json(path)
    if start:
        log = log.where((F.col("day") >= F.to_date(F.lit(start))) & (F.col("timestamp") >= start))
    if end:
        log = log.where((F.col("day") <= F.to_date(F.lit(end))) & (F.col("timestamp") <= end))
    for k, v in equal.items():
        log = log.where(F.col(k) == v)
    return log


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Events from text lines with JSON after some prefix; lines that are no JSON are left out."""
    body = F.expr(f"substring({column}, instr({column}, '{{'))")
    return lines.select(F.from_json(body, schema).alias("e")).where("e IS NOT NULL").select("e.*")


def expired(log: DataFrame, days: int, today: Column | None = None) -> Column:
    """Whether a row's day is older than the retention."""
    return F.datediff(today if today is not None else F.current_date(), F.col("day")) > days
