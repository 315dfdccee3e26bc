import hashlib
import random
import re

from tests.llm.texts import ODD, frame
from wirelake.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}.get(kind, lambda: True)()


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_base_equals_the_definition(spark):
    rnd = random.Random(3)
    parts = ["1", "2", "4111 1111 1111 1111", "4111-1111-1111-1111", "a", "@", "b.c", ".", "..", "-", " ", "  ", "+", "+1 (555) 123-4567", "192.168.0.1", "256.1.1.1", "é", "🙂", "_", "%", "1.2.3.4.5.6.7.8", "x@y.z", "\n", "00", "007", "(", ")"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += [*ODD, "1 " * 20_000 + "1", "9" * 60_000, "a" * 6_000 + "@", "a@b" + ".c" * 500, "+1" * 5000]
    rows = pii.find(frame(spark, [*enumerate(texts), (None, "null@id.org")], spans="x", _text="y", _all="z")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        b = base("null@id.org" if r.doc_id is None else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in PATTERNS]
        assert [x for x in r.spans.split(",") if x and not x.startswith("iban")] == [f"{k}:{s}:{e}" for k, s, e in b]


def test_iban_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433", "call +1 555 123 4567", "number +1 555 123 4567 here"]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    assert [rows[i].spans for i in range(3)] == ["iban:5:32", "iban:0:22", ""]
    assert rows[3].scores.endswith(":0.70") and rows[4].scores.endswith(":0.50")


def test_redaction(spark):
    docs = frame(spark, ["é mail a@b.co, 1.2.3.4 and 4111 1111 1111 1111.", None, "nothing"], extra=1)
    new = pii.redact(docs)
    assert new.columns == docs.columns
    assert [r.text for r in new.orderBy("doc_id").collect()] == ["é mail <EMAIL>, <IP> and <CARD>.", None, "nothing"]


def test_many_and_long_spans(spark):
    texts = ["a@b" + ".c" * 1_000_000, "+1 555 123 4567, " * 100_000, "x@y.zz é " * 50_000]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    assert (rows[0].n_email, rows[1].n_phone, rows[2].n_email) == (1, 100_000, 50_000)
    assert rows[0].spans == f"email:0:{3 + 2_000_000}" and rows[2].spans.endswith(f"email:{9 * 49_999}:{9 * 49_999 + 6}")
    new = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert [new[0], new[1], new[2]] == ["<EMAIL>", "<PHONE>, " * 100_000, "<EMAIL> é " * 50_000]


def test_columns_of_any_name_stay(spark):
    own = {"_text": "zz", "_all": 3, "_email": "e", "email": "f", "spans": 1, "kind": "k"}
    docs = frame(spark, ["mail a@b.co", None], **own)
    rows = pii.redact(docs).orderBy("doc_id").collect()
    assert all(r[k] == v for r in rows for k, v in own.items()) and [r.text for r in rows] == ["mail <EMAIL>", None]
    assert {r.spans for r in pii.find(docs).collect()} == {"email:5:11", ""}


def test_overlaps_give_one_replacement(spark):
    # the phone covers the card's digits and more
    assert [r.text for r in pii.redact(frame(spark, ["+4111 1111 1111 11 a@1.2.3.4 end"])).collect()] == ["<PHONE> <EMAIL> end"]


def test_empty_and_native(spark):
    df = pii.find(frame(spark, []))
    assert df.collect() == []
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("PythonUDF", "Pandas", "MapInArrow"))
