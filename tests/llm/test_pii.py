import hashlib
import re

from larder.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out, counts = [], []
    for kind, pattern in BASE.items():
        n = 0
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            n += 1
            out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, out


ODD = [
    None, "", "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "+1 (555) 123-4567 +12 +1234567890123456789", "4111 1111 1111 1111 4111-1111-1111-1111 " + "4" * 40,
    "🙂 a@b.co 🙂 8.8.8.8", "@@a@b@c.d a..b@c..d a@b.c.d.e.f.", "1 " * 5000 + "a" * 30000 + "1.1." * 3000 + "." * 100 + "9" * 20000, "a.b@c.d" * 500, "+" * 2000 + "+4" * 500, "x@" + "y." * 4000 + "z", "12.34.56.78@a.bc",
]


def test_base_spans_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [(i, t, "x", 1) for i, t in docs + [(10**6 + i, t) for i, t in enumerate(ODD)]] + [(None, "me@x.org", "", 0), (10**6, "me@x.org", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, s int").repartition(4)
    got = {}
    for r in pii.find_personal_data(df).collect():
        got.setdefault((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256), []).append(r.spans)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        counts, spans = brute(text or "")
        found = got[(i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest())]
        assert any(set(spans) <= set(filter(None, s.split(","))) for s in found)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "call +1 555 123 4567")], "doc_id long, text string")
    plan = pii.with_spans(df)._jdf.queryExecution().toString() + pii.redact(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction(spark):
    rows = [(1, "me@x.org or +1 (555) 123-4567, from 10.0.0.1", "k"), (2, None, None), (3, "", ""), (4, "nothing 2024-01-02 here", ""), (5, "🙂me@x.org🙂", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert [out[i].text for i in range(1, 6)] == ["[EMAIL] or [PHONE], from [IP]", None, "", "nothing 2024-01-02 here", "🙂[EMAIL]🙂"]
    assert pii.redact(df).columns == df.columns and out[1].k == "k"


def test_the_model_adds_spans_that_look_like_the_base(spark):
    """Spelled-out emails, told by form from the base ones' neighbours, are found; versions and dates are left."""
    rows = [(i, f"write to user{i}@mail.example.com or user{i} @ mail.example.com today, build 1.2.{i}, {2000 + i}-01-02 10:11:12") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_spans(df)
    model = pii.Trees(pii.contingency(found))
    assert len(model.cells) <= pii.CELLS
    for r in pii.find_personal_data(df).collect():
        assert r.n_email == 1 and r.n_phone == 0 and "card" not in r.spans
        text = rows[r.doc_id][1]
        spelled = re.search(r"user\d+ @ mail.example.com", text)
        assert r.spans.split(",") == [f"email:{m.start()}:{m.end()}" for m in (re.search(r"user\d+@mail.example.com", text), spelled)]


def test_no_candidates(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(df).collect() == []
    one = spark.createDataFrame([(1, "plain words")], "doc_id long, text string")
    r = pii.find_personal_data(one).first()
    assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_addresses_outside_the_base_rules(spark):
    """IPv6 addresses and spelled-out emails are found whether they are one or most of their generator's candidates."""
    odd = ["user [at] host [dot] org", "jo.b(at)mail (dot) example (dot) com", "ann @ mail.example.com", "2001:db8:0:1:1:1:1:1", "2001:db8::ff00:42:8329", "fe80:0:1::"]
    kinds = ["email"] * 3 + ["ip"] * 3
    left = ["meet @ home. Then leave", "00:1a:2b:3c:4d:5e", "1::2::3:4", "1:2:3:4", "at 10:11:12:13 on 2024-01-02 10:11:12"]
    for times in (1, 300):
        texts = [f"write to {o}. Thanks, {i}" for o in odd for i in range(times)] + [f"see {x} now, {i}" for x in left for i in range(40)] + [f"me{i}@x.org" for i in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
        for n, t in enumerate(texts[: len(odd) * times]):
            o = odd[n // times]
            assert spans[n] == f"{kinds[n // times]}:9:{9 + len(o)}", (t, spans[n])
        assert not any(spans[n] for n in range(len(odd) * times, len(texts) - 40))
    clean = pii.redact(df).where("doc_id = 0").first().text
    assert clean == "write to [EMAIL]. Thanks, 0"


def test_forms_outside_the_base_rules_and_look_alikes(spark):
    """Cards side by side and cards behind phones, which the base rules drop, and other separators are found; numbers that only look alike stay."""
    found = {
        "pay 4111111111111111 4012888888881881 now": ["card:4:20", "card:21:37"],
        "pay 4111.1111.1111.1111 now": ["card:4:23"],
        "so +1 (208) 555-1177 4111111111111111 it": ["card:21:37", "phone:3:20"],
        "call 555-123-4567 today": ["phone:5:17"],
        "Tel. 0171 2345678, please": ["phone:5:17"],
        "ask (555) 123-4567 or": ["phone:4:18"],
    }
    left = ["build 10.11.2024.7", "order 4500123456 came", "on 2024-01-12 10:11", "isbn 978-3-16-148410-0", 'token = "9c8b45435718dcc700c184a7e30" x', "9311664600839016 By", "from 1990-1995 2000 on", "about 1 000 000 of", "12:11:10:09 left", "lunch @ 4.50"]
    texts = [*found, *left]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spans = {texts[r.doc_id]: r.spans for r in pii.find_personal_data(df).collect()}
    assert spans == {t: ",".join(s) for t, s in found.items()} | dict.fromkeys(left, "")


def test_precision_and_recall_on_rows_held_out(spark):
    rows = pii.quality(spark, pii.trained(spark)).collect()
    assert {r.generator for r in rows} == set(pii.GENERATORS)
    for r in rows:
        assert r.candidates > 100 and r.personal > 50
        assert r.right >= 0.99 * r.selected and r.right >= 0.85 * r.personal, r


def test_thousands_of_spans_in_one_text(spark):
    """More than a block of each fold: places and replacements stay exact."""
    n, unit = 3000, "mail user@host.com or jo [at] host [dot] org, "
    df = spark.createDataFrame([(1, "🙂" + unit * n)], "doc_id long, text string")
    r = pii.find_personal_data(df).first()
    places = sorted((1 + k * len(unit) + at, 1 + k * len(unit) + end) for k in range(n) for at, end in ((5, 18), (22, 44)))
    assert r.spans == ",".join(f"email:{s}:{e}" for s, e in places) and r.n_email == n
    assert pii.redact(df).first().text == "🙂" + "mail [EMAIL] or [EMAIL], " * n


def test_columns_of_any_name_stay(spark):
    names = ["own", "email", "found", "spans", "t", "__email", "__spans", "a.b", "ip"]
    df = spark.createDataFrame([(1, "me@x.org", *names), (2, None, *names)], ["doc_id", "text", *names])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "[EMAIL]", *names), (2, None, *names)]
    assert pii.redact(df.where("false")).collect() == []


def test_the_same_span_at_both_ends_and_in_the_middle(spark):
    """Whether a span is found does not depend on there being a text around it."""
    personal = ["fe80::1ff:fe23:4567:890a", "2001:db8::ff00:42:8329", "2001:db8:0:1:1:1:1:1", "jo [at] host [dot] org", "jo.b(at)mail (dot) example (dot) com", "ann @ mail.example.com", "(555) 123-4567", "4111.1111.1111.1111", "4111/1111/1111/1111"]
    told = ["call 555-123-4567", "Tel. 0171 2345678"]
    alike = ["2024-01-12 10:11", "978-3-16-148410-0", "1990-1995 2000", "1 000 000", "12:11:10:09", "00:1a:2b:3c:4d:5e", "order 4500123456"]
    frames = [("", ""), ("see ", ""), ("", " now"), ("see ", " now"), ("see ", ". ")]
    texts = [(x, a, b) for x in personal + told + alike for a, b in frames]
    df = spark.createDataFrame([(i, a + x + b) for i, (x, a, b) in enumerate(texts)], "doc_id long, text string").repartition(4)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for i, (x, a, _) in enumerate(texts):
        start = len(a) + (x.index(" ") + 1 if x in told else 0)
        want = "" if x in alike else f"{start}:{len(a) + len(x)}"
        assert spans[i].partition(":")[2] == want, (texts[i], spans[i])


def test_overlapping_additions_are_one(spark):
    rows = ["(call 1-800-555-0199)", "(555) 123-4567 555-123-4567", "call 555-123-4567, call 555-123-4568"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    for r in pii.find_personal_data(df).collect():
        places = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        assert places and all(a[1] <= b[0] for a, b in zip(places, places[1:])), r.spans
