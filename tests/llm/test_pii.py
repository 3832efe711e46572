import hashlib
import math
import random
import re
from collections import defaultdict

from motorlake.llm import pii
from tests.llm.conftest import DOCS, rows, words

#: The base patterns in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def texts():
    rnd = random.Random(8)
    signs = [*"a1.@-+_% 0é🙂()\n,", "192.168.0.1", "256.1.1.1", "007.1.2.3", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (30) 1234-567", "me@x.org", "a.b@c.d.e", "\\"]
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(400)]
    return [None, "", "1" * 30_000, "a" * 30_000 + "@b.c", "+1" + " " * 20_000 + "2", "1.2.3.4.5.6.7.8", "a@b.c_x@d.e", "+1 2345678+12345678", *made]


def test_base_spans(spark):
    data = texts()
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows(data), DOCS)).collect()}
    assert len(got) == len(data)
    for k, t in enumerate(data):
        want = base(t or "")
        spans = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        r = got[k]
        own = ",".join(x for x in r.spans.split(",") if x and not x.startswith("term:"))
        assert own == spans, t
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(a == kind for a, *_ in want) for kind in PLAIN)


def told_terms(data, support=2, threshold=0.6):
    """Brute force: term -> largest disclosure, over whole texts."""
    df, held = defaultdict(set), defaultdict(set)
    for k, t in enumerate(data):
        for kind, i, j in base(t or ""):
            value = (t[i:j]).lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[i:j])
            held[kind, value].add(k)
        for w, *_ in term_places(t):
            df[w].add(k)
    best, n = {}, len(data)
    for mine in held.values():
        if len(mine) == n:
            continue
        for w, theirs in df.items():
            both = mine & theirs
            if len({data[k] for k in both}) >= support:
                info = math.log(n / len(mine))
                best[w] = max(best.get(w, -9.0), (info + math.log(len(both) / len(theirs))) / info)
    return {w: d for w, d in best.items() if d >= threshold}


def term_places(text):
    text = text or ""
    for m in reversed(list(re.finditer(PLAIN["email"], text))):
        text = text[: m.start()] + "@" * (m.end() - m.start()) + text[m.end() :]
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)]


def check_terms(spark, data):
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows(data), DOCS)).collect()}
    told = told_terms(data)
    for k, t in enumerate(data):
        want = [f"term:{a}:{b}" for w, a, b in term_places(t) if w in told]
        assert [x for x in got[k].spans.split(",") if x.startswith("term:")] == want, t
        assert got[k].n_term == len(want)
    return told, got


def test_terms_by_disclosure(spark):
    rnd = random.Random(1)
    data = [words(rnd, 30).replace("w", "common ") for _ in range(60)]
    far = "common " * 800
    data[3] = "call Xyzzy before noon, write to secret@corp.org or common later"
    data[9] = "note: XYZZY common reads " + far + "secret@corp.org daily"
    data[11] = data[9]
    data[12] = "lonely Word near other@corp.org here"
    data[13] = "here xyzzy stands alone"
    told, got = check_terms(spark, data)
    assert "xyzzy" in told and "common" not in told
    assert data[9].index("secret") - data[9].index("XYZZY") > 5000
    assert "term:6:11" in got[9].spans.split(",") and got[9].spans == got[11].spans
    assert got[13].spans == "term:5:10"  # the entity is not named here
    assert "lonely" not in told  # seen in one text only


def test_terms_against_brute_force(spark):
    rnd = random.Random(7)
    syllables = [a + b + c for a in "bdgk" for b in "aeé" for c in "lmn"]
    values = [f"u{k}@mail{k % 3}.example.org" for k in range(6)] + ["10.0.0.7", "4111 1111 1111 1111", "+49 (30) 1234-567"]
    data = [None, ""]
    for _ in range(120):
        kept = [rnd.choice(syllables).capitalize() + (rnd.choice(syllables) if rnd.random() < 0.6 else "") for _ in range(rnd.randrange(25))]
        for v in rnd.sample(values, rnd.choice((0, 0, 0, 1, 2))):
            kept.insert(rnd.randrange(len(kept) + 1), v)
            if rnd.random() < 0.7:
                kept.append(f"near{'abcdefghi'[values.index(v)]}")
        data.append(" ".join(kept))
    values_list = " ".join(f"list{k}@x.org hint{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    data += [values_list, values_list + " again", data[5], data[5], data[40]]
    told, _ = check_terms(spark, data)
    assert len(told) > 20


def test_entity_in_every_document(spark):
    told, _ = check_terms(spark, ["all@x.org one two", "all@x.org one three", "all@x.org four"])
    assert told == {}


def test_sanitise(spark, awkward, nothing):
    data = ["mail a@b.cd or 10.0.0.1 now", None, "nothing here", "+4912345678 é x@y.zz"]
    docs = spark.createDataFrame(rows(data), DOCS)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP] now", None, "nothing here", "[PHONE] é [EMAIL]"]
    assert pii.report(awkward).count() == awkward.count()
    assert pii.report(nothing).count() == 0 and pii.sanitise(nothing).count() == 0
