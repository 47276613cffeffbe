"""Images: parsing, actions, risk, and no planted identifier left."""

import struct

import pytest

from maskwright.dicom import actions, files, job, profile
from maskwright.dicom.policy import is_private, parse_dicom_policy
from maskwright.errors import PolicyError
from maskwright.functions.keys import dataset_key

SECRET = "n0t-a-real-secret/0123456789abcdefXYZ"
T = {k: t for k, (t, _) in profile.TAGS.items()}
PLANTED = ["Meier^Anna", "MRN-4711", "Somewhere 5", "+4989123", "Lost^Observer", "Klinikum", "a@b.co", "1.2.3.4.5", "PRIVATE", "19700315", "Doc^Who"]


def rows(n=0, pixels=True, burned="NO", modality="CT"):
    def a(keyword, values, path=(), vr=None, raw=None):
        return {"path": path, "tag": T.get(keyword, keyword), "vr": vr or profile.TAGS[keyword][1], "values": values, "raw": raw}

    item = ((T["VerifyingObserverSequence"], 0),)
    own = ((T["ReferencedPatientSequence"], 0),)
    free = (("00081140", 0),)
    out = [
        a("00020002", ["1.2.840.10008.5.1.4.1.1.2"], vr="UI"), a("00020003", [f"1.2.3.4.5.{n}"], vr="UI"), a("00020010", [files.EXPLICIT_LITTLE], vr="UI"),
        a("SOPInstanceUID", [f"1.2.3.4.5.{n}"]), a("StudyInstanceUID", ["1.2.3.4.5"]), a("StudyDate", ["20240230"]), a("Modality", [modality]), a("PatientName", ["Meier^Anna"]),
        a("PatientID", ["MRN-4711"]), a("PatientBirthDate", ["19700315"]), a("PatientSex", ["F"]), a("PatientAddress", ["Somewhere 5"]), a("PatientTelephoneNumbers", ["+4989123"]),
        a("InstitutionName", ["Klinikum"]), a("ReferringPhysicianName", ["Doc^Who"]), a("StudyDescription", ["ask a@b.co first"]), a("CalibrationDate", ["20240101", "20240201"]),
        a("00091001", ["PRIVATE"], vr="LO"), a("VerifyingObserverSequence", [], vr="SQ"), a("VerifyingObserverName", ["Lost^Observer"], item), a("ReferencedPatientSequence", [], vr="SQ"),
        a("PatientID", ["MRN-4711"], own), a("00081140", [], vr="SQ"), a("ReferencedSOPInstanceUID", ["1.2.3.4.5"], free), a("Rows", [], raw=struct.pack("<H", 2)), a("BurnedInAnnotation", [burned]),
    ]
    return out + ([a("PixelData", [], vr="OW", raw=b"\1\2\3\4")] if pixels else [])


POLICY = {"version": 1, "dataset": "img", "key": {"inline": SECRET}, "patterns": [{"name": "mail", "builtin": "email", "action": "redact"}]}


def test_round_trip():
    data = files.build(rows())
    again = [{"path": tuple((s["tag"], s["item"]) for s in p), "tag": t, "vr": v, "values": x, "raw": r} for p, t, v, x, r in files.parse(data)]
    assert files.build(again) == data
    assert {(r["tag"], tuple(r["values"])) for r in again if r["path"]} >= {(T["PatientID"], ("MRN-4711",))}
    for bad in (b"", b"\0" * 200, data[:-3]):
        with pytest.raises((files.Unreadable, struct.error)):
            files.parse(bad)


def test_undefined_lengths():
    inner = files._encoded(T["VerifyingObserverName"], "PN", b"A^B ")
    sequence = struct.pack("<HH", 0x0040, 0xA073) + b"SQ\0\0" + struct.pack("<I", files.UNDEFINED)
    sequence += struct.pack("<HHI", 0xFFFE, 0xE000, files.UNDEFINED) + inner + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    data = b"\0" * 128 + b"DICM" + sequence + files._encoded(T["ContentDescription"], "LO", b"after ")
    got = files.parse(data)
    assert [(len(p), t, x) for p, t, _, x, _ in got] == [(0, T["VerifyingObserverSequence"], []), (1, T["VerifyingObserverName"], ["A^B"]), (0, T["ContentDescription"], ["after"])]


def _implicit(given, depth=0, prefix=()):
    """The rows of one level as implicit little endian, items of undefined length."""
    out = b""
    for r in sorted((r for r in given if len(r["path"]) == depth and r["path"] == prefix), key=lambda r: r["tag"]):
        body = r["raw"] if r["raw"] is not None else "\\".join(r["values"]).encode()
        if r["vr"] == "SQ":
            inner = _implicit(given, depth + 1, (*prefix, (r["tag"], 0)))
            body = struct.pack("<HHI", 0xFFFE, 0xE000, files.UNDEFINED) + inner + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        body += b" " * (len(body) % 2)
        out += struct.pack("<HHI", int(r["tag"][:4], 16), int(r["tag"][4:], 16), files.UNDEFINED if r["vr"] == "SQ" else len(body)) + body
    return out


def test_other_encodings():
    import zlib

    given = [r for r in rows() if not r["tag"].startswith("0002")]
    meta = lambda syntax: b"\0" * 128 + b"DICM" + files._encoded("00020010", "UI", syntax.encode())
    unknown = {"path": (), "tag": "00101021", "vr": "LO", "values": ["Hidden^Name"], "raw": None}
    windows = {"path": (), "tag": "00281050", "vr": "DS", "values": ["40"], "raw": None}
    got = files.parse(meta(files.IMPLICIT_LITTLE) + _implicit([*given, unknown, windows]))
    cells = {(tuple(s["tag"] for s in p), t): (vr, v, raw) for p, t, vr, v, raw in got}
    assert cells[(), T["PatientName"]] == ("PN", ["Meier^Anna"], None) and cells[(T["VerifyingObserverSequence"],), T["VerifyingObserverName"]][1] == ["Lost^Observer"]
    assert cells[(), "00281050"] == ("UN", [], b"40") and ((), "00101021") not in cells and ((), "00091001") not in cells and cells[(), "00020010"][1] == [files.EXPLICIT_LITTLE]
    assert cells[(), T["PixelData"]][2] == b"\1\2\3\4" and files.parse(files.build([{"path": tuple((s["tag"], s["item"]) for s in p), "tag": t, "vr": v, "values": x, "raw": r} for p, t, v, x, r in got]))
    plain = files.build([r for r in rows() if not r["tag"].startswith("0002")])
    at = plain.index(struct.pack("<HH", 0x0008, 0x0018))
    squeezed = zlib.compressobj(wbits=-15)
    deflated = meta(files.DEFLATED) + squeezed.compress(plain[at:]) + squeezed.flush()
    assert files.parse(deflated)[1:] == [r for r in files.parse(plain) if not r[1].startswith("0002")]
    for bad in (meta(files.BIG) + b"\0" * 20, meta(files.DEFLATED) + b"\xff" * 20):
        with pytest.raises(files.Unreadable):
            files.parse(bad)


def test_run(spark, tmp_path):
    (tmp_path / "in" / "s").mkdir(parents=True)
    for n in range(2):
        (tmp_path / "in" / "s" / f"{n}.dcm").write_bytes(files.build(rows(n)))
    (tmp_path / "in" / "bad.dcm").write_bytes(b"no")
    report = job.run(spark, POLICY, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "vault"))
    assert report["instances"] == 2 and [r["files"] for r in report["skipped"]] == [1] and report["pixel_risk"][0]["instances"] == 2 and report["highest_pixel_risk"] == "low"
    both = [(tmp_path / "out" / "s" / f"{n}.dcm").read_bytes() for n in range(2)]
    for word in PLANTED:
        assert not any(word.encode() in b for b in both), word
    get = lambda b: {t: v for p, t, _, v, _ in files.parse(b) if not p}
    a, b = map(get, both)
    assert a[T["StudyInstanceUID"]] == b[T["StudyInstanceUID"]] and a[T["SOPInstanceUID"]] != b[T["SOPInstanceUID"]]
    assert a[T["StudyInstanceUID"]][0].startswith("2.25.") and a["00020003"] == a[T["SOPInstanceUID"]]
    assert a[T["PatientID"]][0].startswith("PID-") and a[T["PatientBirthDate"]] == ["19700101"] and a[T["StudyDescription"]] == ["ask [MAIL] first"]
    assert a[T["CalibrationDate"]] == ["20240101", "20240201"] and a[T["ReferringPhysicianName"]] == [] and len(a[T["StudyDate"]][0]) == 8
    nested = [v for p, t, _, v, _ in files.parse(both[0]) if p]
    assert nested == [a[T["StudyInstanceUID"]]]
    with pytest.raises(PolicyError):
        job.run(spark, POLICY, str(tmp_path / "in"), str(tmp_path / "in"))


def table(spark, given):
    return spark.createDataFrame([("i", [], profile.parse_tag(t), vr, v, None) for t, vr, v in given], actions.SCHEMA)


def test_actions(spark):
    tags = [{"tag": "StudyDate", "action": "date_shift", "max_days": 10}, {"tag": "SeriesDate", "action": "date_truncate", "granularity": "year_month"}, {"tag": "Rows", "action": "replace", "value": "1"}, {"tag": "PatientComments", "action": "replace", "value": "none"}, {"tag": "OtherPatientIDs", "action": "pseudonymize", "domain": "p"}, {"tag": "(0010,0010)", "action": "keep"}]
    p = parse_dicom_policy({"version": 1, "dataset": "d", "profile": "none", "tags": tags})
    key = dataset_key(SECRET, "d")
    days = actions.shift_days(key, "StudyDate", 10)
    df = table(spark, [("StudyDate", "DA", ["20240115", "x"]), ("SeriesDate", "DA", ["20240115"]), ("Rows", "US", []), ("PatientComments", "LT", ["a\\b"]), ("OtherPatientIDs", "LO", ["1", "2", "1 "]), ("PatientName", "PN", ["A"])])
    got = {r["tag"]: r for r in actions.deidentify(df, p, key).collect()}
    import datetime

    assert -10 <= days <= 10 and got[T["StudyDate"]]["values"] == [(datetime.date(2024, 1, 15) + datetime.timedelta(days)).strftime("%Y%m%d")] and got[T["StudyDate"]]["refused"]
    assert got[T["SeriesDate"]]["values"] == ["20240101"] and got[T["Rows"]]["refused"] and got[T["PatientComments"]]["values"] == ["none"]
    ids = got[T["OtherPatientIDs"]]["values"]
    assert ids[0] == ids[2] != ids[1] and got[T["PatientName"]]["values"] == ["A"]
    counts = {r["action"]: r["occurrences"] for r in actions.by_action(actions.deidentify(df, p, key)).collect()}
    assert counts["date_shift"] == 1 and "keep" not in counts


@pytest.mark.parametrize(("modality", "burned", "pixels", "level"), [("CT", "NO", True, "low"), ("CT", "YES", True, "high"), ("US", "NO", True, "elevated"), ("US", None, True, "high"), ("CT", None, True, "unknown"), ("CT", "NO", False, "low")])
def test_pixel_risk(spark, modality, burned, pixels, level):
    given = [("Modality", "CS", [modality])] + ([("BurnedInAnnotation", "CS", [burned])] if burned else []) + ([("PixelData", "OW", [])] if pixels else [])
    assert actions.pixel_risk(table(spark, given)).first()["level"] == level


def test_tags_and_policies():
    assert profile.parse_tag("PatientName") == profile.parse_tag("(0010,0010)") == profile.parse_tag("00100010") == "00100010"
    assert is_private("00091001") and not is_private("00090000") and not is_private("00100010")
    assert len(profile.basic_rules()) == 104 + 15
    for bad in ({"tags": [{"tag": "Nope", "action": "keep"}]}, {"tags": [{"tag": "PatientName", "action": "keep", "value": "x"}]}, {"profile": "x"}, {"tags": [{"tag": "PatientName", "action": "keep"}] * 2}):
        with pytest.raises(PolicyError):
            parse_dicom_policy({"version": 1, "dataset": "d"} | bad)


def test_risk_sorts_narrow_rows(spark, tmp_path, monkeypatch):
    """What is sorted by instance holds no attribute values but those that count, and a table of one row group is dealt out."""
    from maskwright.dicom import queries as registered
    from maskwright.sources import formats

    table = spark.createDataFrame([], actions.SCHEMA)
    plan = actions.pixel_risk(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "values" not in next(line for line in plan.splitlines() if "Aggregate" in line)
    item = [(T["VerifyingObserverSequence"], 0)]
    cells = [
        ("a", item, T["PixelData"], "OW", [""]), ("a", [], T["Modality"], "CS", [" US ", "CT"]), ("b", None, T["PixelData"], "OW", None), ("b", [], T["BurnedInAnnotation"], "CS", ["YES"]),
        ("b", item, T["Modality"], "CS", ["US"]), ("c", [], None, "LO", ["x"]), ("d", [], T["PixelData"], "OW", []), ("d", [], T["Modality"], "CS", []), ("d", [], T["Modality"], "CS", ["MR"]),
    ]
    odd = spark.createDataFrame([(*c, None) for c in cells], actions.SCHEMA)
    got = {r["instance"]: tuple(r)[1:] for r in actions.pixel_risk(odd).collect()}
    assert got == {"a": (False, None, "US", "low"), "b": (True, "YES", None, "high"), "c": (None, None, None, "unknown"), "d": (True, None, "MR", "unknown")}
    spark.range(1, 101).selectExpr("id AS c_custkey", "'n' AS c_name", "0 AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(formats, "ROWS_A_TASK", 30)
    for made in (registered.attributes(spark, str(tmp_path)), registered.action_attributes(spark, str(tmp_path))):
        assert made.rdd.getNumPartitions() == 4 and made.select("instance").distinct().count() == 100
