import hashlib
import random
import re

import pytest
from spanmill.llm.pii import BASE, find, listed, luhn, masked, op9_pii, redact, spans

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(RX[k], text) if ok[k](m[0])] for k in BASE}


@pytest.mark.parametrize(
    "text",
    ["", "a@b.c@d.e", "@b.c", "x@y", "x@y.", "a@@b.c", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (212) 555-0100", "+12 +3456789012.", "++49 30 1234567", "é😀a.b+c@d-e.fg. 10.0.0.1", "1..2.3.4.5", "0000000000000.1.1.1"],
)
def test_base_cases(text):
    got = find(text)
    assert {k: got[k] for k in BASE} == plain(text)


def test_base_random():
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B", "@", "@", ".", ".", "-", " ", "+", "1", "2", "0", "99", "255", "(", ")", "é", "4111111111111111", "x@y.z"]) for _ in range(rng.randrange(30)))
        got = find(text)
        assert {k: got[k] for k in BASE} == plain(text), text


def test_long_runs_take_linear_time():
    text = "7" * 300_000 + " " + "a" * 300_000 + "@" + "b" * 300_000 + " 1." * 50_000
    assert find(text)["email"] == [] and find(text)["ip"] == []


def test_extra_kinds():
    t = "IBAN: DE89 3704 0044 0532 0130 00 AND SSN 078-05-1120, iban GB00WEST12345698765432; http://me:secret@host/x"
    got = find(t)
    assert [t[a:b] for a, b in got["account"]] == ["DE89 3704 0044 0532 0130 00", "078-05-1120"]
    assert [t[a:b] for a, b in got["credential"]] == ["me:secret"]


def test_masked():
    assert masked("mail a@b.co, 10.0.0.1 or +1 212 555 0100.") == "mail <EMAIL>, <IP> or <PHONE>."
    assert masked(None) is None and masked("") == "" and masked("clean") == "clean"
    assert masked("http://me:p@h.com") == "http://<CREDENTIAL>"


def test_frames(spark):
    rows = [(1, "a@b.co 10.0.0.1", 15), (2, None, None), (3, "", 0), (3, "", 0), (None, "+12345678", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = sorted(map(tuple, spans(df).collect()), key=str)
    want = [(i, *(len(find(t)[k]) for k in BASE), hashlib.sha256(listed(find(t), BASE).encode()).hexdigest(), listed(find(t)), sum(map(len, find(t).values()))) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    out = redact(df)
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "<EMAIL> <IP>", 12), (2, None, None), (3, "", 0), (3, "", 0), (None, "<PHONE>", 7)], key=str)
    assert spans(df.limit(0)).count() == 0


def test_added_kinds_have_no_windows():
    for scheme, secret in (("https://", "s" * 5000), ("HTTPS://", "secret"), ("Ftp://", "x"), ("ssh://", "a+b:c")):
        t = f"see {scheme}me:{secret}@host/x and a@b.co"
        assert [t[a:b] for a, b in find(t)["credential"]] == [f"me:{secret}"]
    assert find("http://host/a:b@c gopher://me:x@h http://a:b c@d")["credential"] == []
    t = "IBAN:" + " " * 500 + "NO93 8601 1117 947"
    assert [t[a:b] for a, b in find(t)["account"]] == ["NO93 8601 1117 947"]
    for text in ("http://" + "a" * 300_000, "http://a:" + "b" * 300_000, "https://a:b" * 50_000, "iban" + " " * 300_000, "iban no " * 50_000):
        assert find(text)["credential"] == [] and find(text)["account"] == []


def test_cues_in_any_case_and_secrets():
    t = "sSn: 078-05-1120, iBaN DE89370400440532013000"
    assert [t[a:b] for a, b in find(t)["account"]] == ["078-05-1120", "DE89370400440532013000"]
    t = """TOKEN = "9233A8ECF7C5B09F", Api_Key: 'ab12-cd34.ef', access_token=x1y2z3w4v5 password is short1, pwd = abc12, token: 12345678, secret: wordswords"""
    assert [t[a:b] for a, b in find(t)["credential"]] == ["9233A8ECF7C5B09F", "ab12-cd34.ef", "x1y2z3w4v5"]
    t = "\u0130\u0130 token='a1b2c3d4e5' tokentoken=q1q2q3q4q5"  # lower case of the first letter is longer
    assert [t[a:b] for a, b in find(t)["credential"]] == ["a1b2c3d4e5", "q1q2q3q4q5"]
    assert masked(t) == "\u0130\u0130 token='<CREDENTIAL>' tokentoken=<CREDENTIAL>"
    for text in ("token" * 60_000, "token=" * 60_000, "token " + " " * 300_000, "token='" + "a" * 300_000, "SSN" * 100_000):
        assert find(text)["credential"] == []


def test_query(spark, tmp_path):
    rows = [(1, "a@b.co token = 'a1b2c3d4e5' 10.0.0.1"), (2, None), (None, "+12345678"), (None, "+12345678"), (3, "x" * 200_000 + " 10.1.1.1")]
    spark.createDataFrame([(*r, "text") for r in rows], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_pii(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        base = plain(t or "")
        told = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
        want.append((i, *(len(base[k]) for k in BASE), hashlib.sha256(told.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.n_spans for r in got) == [0, 1, 1, 1, 3] and [r.spans for r in got if r.doc_id == 1] == ["email:0:6,ip:28:36,credential:16:26"]
