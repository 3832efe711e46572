import html
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from motorlake.llm import language

WORDS = {"aa": "the of and to in that ther ing tion", "bb": "der die und ein nicht ich sch ung", "cc": "le de les que une dans eau oux"}
PAGES = "page_id long, url string, html string, host string, own string, lang string"
DOCS = "doc_id long, text string, lang string, n long"


def talk(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(k, talk(rnd, "abc"[k % 3] * 2, 80), "abc"[k % 3] * 2, 1) for k in range(90)] + [(91, None, "aa", 1), (92, "x y", None, 1), (93, "", "bb", 1)]
    return spark.createDataFrame(rows, DOCS)


def run(spark, docs, data):
    rows = [(k, u, h, "z", "z", "z") for k, (u, h) in enumerate(data)]
    got = language.languages(spark.createDataFrame(rows, PAGES), docs).collect()
    assert len(got) == len(rows)
    return {r.page_id: r for r in got}


def test_evidence(spark, docs):
    rnd = random.Random(3)
    data = [(f"http://x{k % 4}.org/{k}", f"<html lang='{lang}'><body><script>le de les</script><p>{talk(rnd, lang, 40)}</p></body>") for k in range(90) for lang in ["abc"[k % 3] * 2]]
    data += [(f"http://only-b.net/{k}", f"<html lang=\"bb\"><p>{talk(rnd, 'bb', 30)}") for k in range(30)]
    n = len(data)
    data += [
        ("http://x1.org/", f"<html lang='cc'><p>{talk(rnd, 'aa', 200)}"),  # a wrong declaration against a long text
        ("http://only-b.net/q", ""),  # nothing but the host
        ("http://new.net/q", ""),  # nothing but the suffix
        ("http://x0.org/z", "<html lang=cc>"),  # nothing but the declaration
        (None, None), ("bad url", "<html lang='zz-Q'>"), ("http://x1.org/", data[0][1]),
    ]
    got = run(spark, docs, data)
    assert all(got[k].lang == "abc"[k % 3] * 2 for k in range(90))
    assert [got[n + k].lang for k in range(4)] == ["aa", "bb", "bb", "cc"]
    assert got[n + 4].lang in WORDS and got[n + 5].declared == "zz"
    assert got[n + 1].confidence > 0.9 and got[n + 4].confidence < 0.9


def test_nothing_known(spark, docs):
    none = spark.createDataFrame([], DOCS)
    got = run(spark, none, [("http://a.org", "<p>x</p>")])
    assert got[0].lang is None and got[0].confidence == 0
    assert run(spark, docs, []) == {}


def test_only_whole_names_are_unseen():
    assert language.UNSEEN.sub(" ", "<head><title>no</title></head><head-line>a</head-line><template-box>b</template-box><style >no</style>c").split() == ["a", "b", "c"]


def test_declaration_is_the_lang_attribute_of_the_html_element():
    cases = {
        "<html data-lang='de' lang=\"fr-CA\">": "fr",
        "<!-- <html lang='de'> --><script>'<html lang=de>'</script><HTML LANG=it>": "it",
        "<html title=\"a > lang='de'\" lang='es'>": "es",
        "<html xml:lang='de'>": None,
        "<html lang=''><html lang='de'>": None,
        "<html lang='deutsch'>": None,
        "<body><html lang='de'>": None,
        "<html-x lang='de'>": None,
        "<html lang=de": "de",
        "": None,
    }
    assert {k: language.declared(k) for k in cases} == cases
    assert language.declared("<html a='x " * 100_000) is None  # in linear time
    assert language.declared("<!-- " * 100_000) is None


def test_rare_values_of_lang_are_one_class(spark, docs):
    rnd = random.Random(9)
    many = spark.createDataFrame([(k, talk(rnd, "abc"[k % 3] * 2, 5), "abc"[k % 3] * 2 if k % 20 else f"odd{k}", 1) for k in range(3000)], DOCS)
    langs, logs = language.profiles(many)
    assert langs == ["aa", "bb", "cc", language.OTHER] and logs.shape == (4, language.BUCKETS)


def fused(docs, pages):
    """Brute force: the same fusion in plain Python over dictionaries."""
    tri = lambda t: [b for part in language.trigrams(np.frombuffer(t.encode(), np.uint8)) for b in part.tolist()]
    counts = defaultdict(Counter)
    for text, lang in docs:
        if lang:
            counts[lang].update(tri(text or ""))
    langs = sorted(k for k in counts if counts[k])
    size = {x: sum(counts[x].values()) + 0.5 * language.BUCKETS for x in langs}

    def softmax(scores):
        top = max(scores.values())
        total = sum(math.exp(s - top) for s in scores.values())
        return {x: math.exp(s - top) / total for x, s in scores.items()}

    seen = []
    for url, page in pages:
        host = (url or "").split("//")[1].split("/")[0] if "//" in (url or "") else ""
        text = html.unescape(language.UNSEEN.sub(" ", page or ""))
        raw = {x: sum(language.TEMPER * math.log((counts[x][b] + 0.5) / size[x]) for b in tri(text)) for x in langs}
        likely = {x: round(s - max(raw.values()), 6) for x, s in raw.items()}
        told = language.declared(page or "")
        seen.append((host, host.rpartition(".")[2], "-" if told is None else told if told in langs else "?", likely, {x: math.floor(p * 1000 + 0.5) for x, p in softmax(likely).items()}))
    sums = lambda keep: {x: sum(s[4][x] for s in seen if keep(s)) for x in langs}
    overall = sums(lambda s: True)
    total, kinds = sum(overall.values()), [*langs, "-", "?"]
    prior = {x: (overall[x] / 1000 + 1) / (total / 1000 + len(langs)) for x in langs}

    def leaning(n, parent):
        return {x: (n[x] / 1000 + language.STRENGTH * parent[x]) / (sum(n.values()) / 1000 + language.STRENGTH) for x in langs}

    out = []
    for host, suffix, told, likely, own in seen:
        at_host = sums(lambda s: s[0] == host)
        by_host = leaning({x: at_host[x] - own[x] for x in langs}, leaning(sums(lambda s: s[1] == suffix), prior))
        said = sums(lambda s: s[2] == told)
        share = (sum(said.values()) + 1000) / (total + 1000 * len(kinds))
        p = softmax({x: likely[x] + math.log(by_host[x]) + math.log((said[x] / 1000 + language.STRENGTH * share) / (overall[x] / 1000 + language.STRENGTH)) for x in langs})
        out.append((max(langs, key=lambda x: (round(p[x], 6), -langs.index(x))), max(p.values())))
    return out


def test_against_brute_force(spark, docs):
    rnd = random.Random(12)
    pages = []
    for k in range(70):
        lang = rnd.choice(["aa", "bb", "cc"])
        said = rnd.choice([f" lang='{lang}'", "", " lang=bb", " lang=zz"])
        pages.append((f"http://h{rnd.randrange(5)}.{rnd.choice(['org', 'net'])}/{k}", f"<html{said}><p>{talk(rnd, lang, rnd.randrange(6))}"))
    pages += [(None, None), ("", ""), pages[0], ("http://h1.org/long", f"<html><p>{talk(rnd, 'bb', 200_000)}")]
    got = run(spark, docs, pages)
    want = fused([(r.text, r.lang) for r in docs.collect()], pages)
    for k, (lang, confidence) in enumerate(want):
        assert got[k].lang == lang and abs(got[k].confidence - confidence) < 1e-5, pages[k]
