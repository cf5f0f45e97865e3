"""Tollgate: a versioned data contract on raw JSON records, enforced with Spark in batch and in streams."""

from tollgate.contract import KINDS, PURCHASE, QUARANTINE, REASONS, STAGES, Contract, Field, Kind, Settings
from tollgate.contract import VERSION as __version__
from tollgate.functions.reasons import highest, reason_for
from tollgate.operators.generator import FAULTS, Fault, GeneratorConfig, generate
from tollgate.operators.ledger import classify, events_deduplicated, registry_counts
from tollgate.operators.verdict import accepted, rejected, validate
from tollgate.plans.batch import load_file, load_files
from tollgate.plans.report import build_report, format_report
from tollgate.sinks import InsertOnlySink, JsonSink, ParquetSink, Sink, build_sink

__all__ = [
    "FAULTS", "PURCHASE", "QUARANTINE", "REASONS", "STAGES", "Contract", "Fault", "Field", "GeneratorConfig", "InsertOnlySink", "JsonSink", "KINDS", "Kind", "ParquetSink", "Settings",
    "Sink", "__version__", "accepted", "build_report", "build_sink", "classify", "events_deduplicated", "format_report", "generate", "highest", "load_file", "load_files",
    "reason_for", "registry_counts", "rejected", "validate",
]
