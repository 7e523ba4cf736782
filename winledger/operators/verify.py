"""Programmatic verifiers as columns, and the rule that picks the strongest verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winledger.functions.jsontext import json_matches_schema, json_superset
from winledger.functions.text import squeeze
from winledger.schema import VERIFICATION

GRADE_ORDER = {"measured": 0, "derived": 1}
NUMBER = r"(?U)(-?\d+(?:\.\d+)?)"


def verdict(passed: Column, signal, *, method="programmatic", confidence=1.0, grade="measured"):
    """A verification struct; NULL ``passed`` counts as a failure."""
    return F.struct(
        F.when(passed, "pass").otherwise("fail").alias("status"),
        F.lit(method).alias("method"),
        (signal if isinstance(signal, Column) else F.lit(signal)).alias("signal"),
        (confidence if isinstance(confidence, Column) else F.lit(float(confidence)))
        .alias("confidence"),
        F.lit(grade).alias("evidence_grade"),
    )


def unknown_verdict() -> Column:
    return F.struct(
        F.lit("unknown").alias("status"), F.lit("programmatic").alias("method"),
        F.lit("none").alias("signal"), F.lit(0.0).alias("confidence"),
        F.lit("declared").alias("evidence_grade"),
    )


def verify_exit_code(code: Column) -> Column:
    return F.when(code.isNotNull(), verdict(code == 0, "test_exit_code"))


def verify_json_schema(output: Column, schema: Column) -> Column:
    """``schema`` is JSON text; a keyword outside the supported subset is an error."""
    both = output.isNotNull() & schema.isNotNull()
    return F.when(both, verdict(json_matches_schema(output, schema), "schema_validation"))


def verify_regex(output: Column, pattern: Column) -> Column:
    """Search with a per-row pattern (Java syntax; Unicode classes are switched on)."""
    both = output.isNotNull() & pattern.isNotNull()
    return F.when(
        both, verdict(F.regexp_like(output, F.concat(F.lit("(?U)"), pattern)), "regex_contract")
    )


def verify_acceptance(accepted: Column, retried: Column, corrected: Column) -> Column:
    """Accepted downstream, or neither retried within ten minutes nor corrected."""
    yes = F.coalesce(accepted, F.lit(False))
    rejected = F.coalesce(retried, F.lit(False)) | F.coalesce(corrected, F.lit(False))
    return F.when(
        accepted.isNotNull() | retried.isNotNull(),
        verdict(
            yes | ~rejected, "silent_acceptance", method="downstream",
            confidence=F.when(yes, 1.0).otherwise(0.7), grade="derived",
        ),
    )


def verify_equivalence(expected: Column, candidate: Column, exit_code: Column) -> Column:
    """A candidate against a proven-good output: same tests pass, JSON superset, same numbers, or
    the same text up to white space and case."""
    untold = exit_code.isNull()  # where the exit code decides, no JSON is read
    js = json_superset(F.when(untold, expected), F.when(untold, candidate))
    nums = F.array_sort(F.regexp_extract_all(expected, F.lit(NUMBER), 1))
    found = F.array_sort(F.regexp_extract_all(candidate, F.lit(NUMBER), 1))
    off = (F.size(nums) > 0) & (nums != found)
    text = F.lower(squeeze(expected)) == F.lower(squeeze(candidate))
    by_test = exit_code.isNotNull()
    passed = (
        F.when(by_test, exit_code == 0)
        .when(js["is_json"] & ~js["parses"], False)
        .when(js["is_json"], js["covered"])
        .when(off, False)
        .otherwise(text)
    )
    signal = (
        F.when(by_test, "equiv_test_pass")
        .when(js["is_json"] & ~js["parses"], "equiv_json_unparseable")
        .when(js["is_json"], "equiv_json_fields")
        .when(off, "equiv_number_mismatch")
        .otherwise("equiv_text_exact")
    )
    return F.when(expected.isNotNull() & candidate.isNotNull(), verdict(passed, signal))


def resolve_verdicts(ranked: Column) -> Column:
    """From an array of struct(rank, verdict) in registration order (verdict NULL when not
    applicable): the strongest rank decides; inside it any failure wins, else the first."""
    live = F.filter(ranked, lambda r: r["verdict"].isNotNull())
    best = F.array_min(F.transform(live, lambda r: r["rank"]))
    top = F.filter(live, lambda r: r["rank"] == best)
    failed = F.filter(top, lambda r: r["verdict"]["status"] == "fail")
    pick = F.coalesce(F.get(failed, F.lit(0)), F.get(top, F.lit(0)))
    return F.coalesce(pick["verdict"], unknown_verdict())


@dataclass
class VerifierSet:
    """Verifiers by name, applied together. Each is a pair of columns over the artifact table."""

    entries: list[tuple[str, int, Column, Column]] = field(default_factory=list)

    def register_verifier(self, name: str, grade: str, applies: Column, result: Column) -> VerifierSet:
        if any(name == n for n, *_ in self.entries):
            raise ValueError(f"verifier {name} is already registered")
        self.entries.append((name, GRADE_ORDER[grade], applies, result))
        return self

    def verify(self, artifacts: DataFrame, *, into: str = "verification") -> DataFrame:
        """Add the winning verdict of every row: by grade, failures before passes."""
        given = [
            (rank, F.when(applies, result.cast(VERIFICATION)))
            for _, rank, applies, result in self.entries
        ]
        in_order = []
        for rank in sorted(GRADE_ORDER.values()):
            mine = [v for r, v in given if r == rank]
            in_order += [F.when(v["status"] == "fail", v) for v in mine] + mine
        return artifacts.withColumn(into, F.coalesce(*in_order, unknown_verdict()))


ARTIFACT_COLUMNS = {
    "exit_code": "int", "output_text": "string", "json_schema": "string",
    "contract_regex": "string", "accepted_downstream": "boolean", "retried_within_10m": "boolean",
    "correction_followed": "boolean", "expected_output": "string", "candidate_exit_code": "int",
}


def with_artifacts(df: DataFrame) -> DataFrame:
    """Add missing artifact columns as NULL."""
    absent = {c: F.lit(None).cast(t) for c, t in ARTIFACT_COLUMNS.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def default_verifiers() -> VerifierSet:
    """Equivalence, exit code, schema and pattern (measured), then silent acceptance (derived)."""
    c = F.col
    out, have = c("output_text"), c("output_text").isNotNull()
    return (
        VerifierSet()
        .register_verifier(
            "output_equivalence", "measured", have & c("expected_output").isNotNull(),
            verify_equivalence(c("expected_output"), out, c("candidate_exit_code")))
        .register_verifier(
            "exit_code", "measured", c("exit_code").isNotNull(), verify_exit_code(c("exit_code")))
        .register_verifier(
            "json_schema", "measured", have & c("json_schema").isNotNull(),
            verify_json_schema(out, c("json_schema")))
        .register_verifier(
            "regex_contract", "measured", have & c("contract_regex").isNotNull(),
            verify_regex(out, c("contract_regex")))
        .register_verifier(
            "silent_acceptance", "derived",
            c("accepted_downstream").isNotNull() | c("retried_within_10m").isNotNull(),
            verify_acceptance(c("accepted_downstream"), c("retried_within_10m"),
                              c("correction_followed")))
    )


def resolve_outputs(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases (expected_ref, output_ref) with both texts looked up in ``outputs`` (ref, text) and a
    pass flag by equivalence. A pointer that does not resolve never passes."""
    expected = outputs.select(F.col("ref").alias("expected_ref"),
                              F.col("text").alias("expected_output"))
    candidate = outputs.select(F.col("ref").alias("output_ref"), F.col("text").alias("output_text"))
    code = F.col("candidate_exit_code") if "candidate_exit_code" in cases.columns else F.lit(
        None).cast("int")
    result = verify_equivalence(F.col("expected_output"), F.col("output_text"), code)
    return (
        cases.join(expected, "expected_ref", "left").join(candidate, "output_ref", "left")
        .withColumn("_v", result)
        .withColumn("passed", F.coalesce(F.col("_v.status") == "pass", F.lit(False)))
        .withColumn("signal", F.col("_v.signal"))
        .drop("_v")
    )


def schema_fallback(cases: DataFrame, outputs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Cases judged only by their cluster's JSON schema (cluster_id, json_schema); weaker than
    equivalence. No output or no schema never passes."""
    candidate = outputs.select(F.col("ref").alias("output_ref"), F.col("text").alias("output_text"))
    ok = json_matches_schema(F.col("output_text"), F.col("json_schema"))
    return (
        cases.join(candidate, "output_ref", "left").join(schemas, "cluster_id", "left")
        .withColumn("passed", F.coalesce(ok, F.lit(False)))
    )
