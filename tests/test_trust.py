"""Every problem of an entry alone and beside another, and the states that follow."""

import pytest

from paperglass.operators import trust as T

ENTRY = "public_id string, kind string, identity_fields map<string,string>, quality_summary map<string,string>, evidence_labels array<string>, selected_value string"
TAG = {"scheme": "s", "version": "1", "code": "c"}
GOOD = {"content": "complete", "answer_presence": "present", "answer_verification": "source_verified"}


def quality(spark, kind="tag", identity=TAG, summary=None, labels=(), selected=None):
    return T.entry_quality(spark.createDataFrame([("x", kind, identity, summary, None if labels is None else list(labels), selected)], ENTRY))


@pytest.mark.parametrize(("kind", "identity", "found"), [
    ("tag", TAG, []),
    ("tag", None, ["identity_not_mapping"]),
    ("tag", {}, ["identity_empty"]),
    ("tag", {"scheme": "s", "code": ""}, ["identity_missing_key:version", "identity_empty_value:code"]),
    ("tag", {**TAG, "scheme": None, "version": "\x01"}, ["identity_none_value:scheme", "identity_unknown_value:version"]),
    ("tag", {**TAG, "code": "__unknown__"}, ["identity_unknown_encoding:code"]),
    ("tag", {**TAG, "code": "a__unknown__b"}, []),
    ("tag", {**TAG, "code": '["a","__unknown__"]', "version": '{"k":"\\u0001"}'}, ["identity_unknown_value:version", "identity_unknown_encoding:code"]),
    ("tag", {**TAG, "more": ""}, []),
    ("question", {"system": "s", "container_native_identity": "c", "native_id": "1", "number_path": "1", "parent_native_id": "\x01"}, []),
    ("question", {"system": "s", "container_native_identity": "c", "native_id": "1", "number_path": "1"}, ["identity_missing_key:parent_native_id"]),
    ("widget", {"b": None, "a": "[]", "c": "x"}, ["identity_empty_value:a", "identity_none_value:b"]),
    (None, {"a": "x"}, []),
])
def test_identity(spark, kind, identity, found):
    assert quality(spark, kind, identity).first().identity_problems == found


@pytest.mark.parametrize(("kind", "summary", "labels", "selected", "state", "reasons"), [
    ("question", GOOD, ["copied_snapshot"], None, "verified", []),
    ("question", GOOD, ["static_inspection"], None, "partial", ["verification_without_authoritative_evidence"]),
    ("question", GOOD, [], None, "partial", ["content_claim_without_evidence", "verification_without_authoritative_evidence"]),
    ("question", GOOD, None, None, "partial", ["content_claim_without_evidence", "verification_without_authoritative_evidence"]),
    ("question", GOOD, ["rumour", "copied_snapshot", "rumour"], None, "partial", ["unknown_evidence_label:rumour"]),
    ("answer", {**GOOD, "answer_verification": "manual_adjudicated"}, ["static_inspection"], "B", "verified", []),
    ("answer", {**GOOD, "answer_verification": "manual_adjudicated"}, ["static_inspection"], "  ", "partial", ["verification_without_manual_decision"]),
    ("answer", {**GOOD, "answer_presence": "missing"}, ["copied_snapshot"], None, "partial", ["quality_claim_contradiction"]),
    ("answer", {**GOOD, "content": "missing", "answer_verification": "manual_adjudicated"}, ["x"], None, "partial", ["unknown_evidence_label:x", "verification_without_manual_decision", "quality_claim_contradiction"]),
    ("asset", {"content": "complete"}, ["static_inspection"], None, "verified", []),
    ("asset", {"content": "complete"}, [], None, "partial", ["content_claim_without_evidence"]),
    ("asset", GOOD, ["copied_snapshot"], None, "partial", ["answer_axis_not_applicable"]),
    ("asset", {"content": "partial", "answer_presence": "unknown"}, [], None, "partial", ["content_not_complete"]),
    ("question", {"content": "partial"}, [], None, "partial", ["content_not_complete", "answers_not_verified"]),
    ("question", {"content": "complete", "answer_verification": "conflicting"}, ["static_inspection"], None, "partial", ["answers_not_verified"]),
    ("question", {}, ["static_inspection"], None, "unknown", ["no_quality_information"]),
    ("question", None, [], None, "unknown", ["no_quality_information"]),
    ("question", {"other": "x"}, [], None, "unknown", ["no_quality_information"]),
    ("asset", {"content": None}, [], None, "partial", ["content_not_complete"]),
    (None, {"content": "complete"}, ["static_inspection"], None, "verified", []),
])
def test_quality(spark, kind, summary, labels, selected, state, reasons):
    row = quality(spark, kind, {"a": "b"}, summary, labels, selected).first()
    assert (row.state, row.reasons) == (state, reasons)


def test_records(spark):
    found = T.problem_records(quality(spark, "asset", {"system": ""}, GOOD, [])).collect()
    assert {(r.code, r.detail) for r in found} == {
        ("identity_unresolved", "identity_empty_value:system; identity_missing_key:media_type; identity_missing_key:sha256; identity_missing_key:storage_mode"), ("quality_claim_invalid", "answer_axis_not_applicable; content_claim_without_evidence"),
    }
    assert T.problem_records(quality(spark, summary={"content": "complete"}, labels=["copied_snapshot"])).count() == 0
