import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from claimloom.llm import langid as L
from claimloom.llm.words import strings

PAGES = "page_id bigint, url string, html string, host string, best string, suffix string"
SYLLABLES = {"aa": ["the", "er", "wh", "on"], "bb": ["ei", "sch", "ü", "ng"], "cc": ["éa", "ou", "que", "ier"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def made(seed=1, n=150):
    rng = random.Random(seed)
    docs = [(i, words(rng, lang, 40), lang, "x") for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(90))]
    pages, want = [], {}
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        size = 0 if i % 10 == 0 else 60
        url = f"https://{rng.choice(['www.', ''])}site{i % 3}{i % 2}.example.{'org' if i % 3 else 'net'}/p/{i}"
        declared = lang if i % 7 else rng.choice(list(SYLLABLES))
        pages.append((i, url, f'<html lang="{declared}-XX"><script>var the="{words(rng, "aa", 30)}"</script><!-- er --><p>{words(rng, lang, size)}&eacute;</p></html>' if i % 11 else f"<p>{words(rng, lang, size)}</p>"))
        want[i] = lang
    return docs, pages, want


def frames(spark, docs, pages):
    return spark.createDataFrame([(*p, "a", "b", "c") for p in pages], PAGES), spark.createDataFrame(docs, "doc_id bigint, text string, lang string, best string")


def by_hand(docs, pages):
    """The same posterior with dictionaries, page by page."""
    names = sorted({d[2] for d in docs})
    model = L.TextModel([d[1] for d in docs], [d[2] for d in docs])
    rows = []
    for i, url, html in pages:
        host = (re.match(L._HOST, url or "") or [None, ""])[1].lower()
        domain = ".".join(host.split(".")[-2:])
        suffix = host.rpartition(".")[2] if "." in host else ""
        declared = (re.search(L._DECLARED, html or "") or [None, ""])[1].lower()
        ll = model.score(strings(pa.array([L.visible(html)])))[0] * L.TEMPER
        best = int(ll.argmax()) if ll.max() > ll.min() else -1
        rows.append((i, host, domain, suffix, declared if declared in names or not declared else "other", ll, best))
    count = [defaultdict(Counter) for _ in range(4)]
    total = Counter(r[6] for r in rows if r[6] >= 0)
    for r in rows:
        for c, key in zip(count, r[1:5]):
            c[key][r[6]] += r[6] >= 0
    out = {}
    for i, host, domain, suffix, declared, ll, best in rows:
        s = []
        for x in range(len(names)):
            own, some = float(best == x), float(best >= 0)
            p = (total[x] - own + 1) / (sum(total.values()) - some + len(names))
            for c, key in ((count[1], domain), (count[0], host)):
                p = (c[key][x] - own + L.STRENGTH * p) / (sum(c[key].values()) - some + L.STRENGTH)
            d = (count[3][declared][x] - own + (1 if declared == names[x] else 0.1)) / (total[x] - own + 1 + 0.1 * (len(names) + 1))
            u = (count[2][suffix][x] - own + 1) / (total[x] - own + len(count[2]) + 1)
            s.append(ll[x] + math.log(d) + math.log(u) + math.log(p))
        s = np.array(s)
        out[i] = names[int(s.argmax())], float(1 / np.exp(s - s.max()).sum())
    return out


def test_posterior_against_dictionaries_and_truth(spark):
    docs, pages, want = made()
    got = {r.page_id: r for r in L.identify(*frames(spark, docs, pages)).collect()}
    hand = by_hand(docs, pages)
    assert len(got) == len(pages)
    for i, r in got.items():
        assert r.lang == hand[i][0] and abs(r.p_lang - hand[i][1]) < 1e-6
    assert np.mean([got[i].lang == want[i] for i in want]) > 0.97


def test_visible():
    assert L.visible('<html><style>p{}</style><NAV><a>no</a></NAV>a<!-- x > y --><b>b&amp;c</b>\n<script>"</p>"</script>') == "a b&c"


def test_broken_pages_take_one_scan():
    import time

    began = time.process_time()
    for bit in ("<script ", "<!-- ", "<nav></script", "< ", "<script>a</style", "<html ", "&amp;<"):
        L.visible(bit * (1_000_000 // len(bit)))
    assert time.process_time() - began < 10
    hidden = re.compile(r"(?is)<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(4)
    bits = ["<", "<script", ">", "</script>", "<!--", "-->", "x", " ", "</NAV >", "<nav>", "<style a", "</style>", "<b"]
    for _ in range(5000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert L.visible(page) == re.sub(r"\s+", " ", hidden.sub(" ", page)).strip()


def test_hot_hosts_are_joined_alike(spark, monkeypatch):
    from claimloom.llm import session

    docs, pages, _ = made(3, 120)
    want = {r.page_id: (r.lang, round(r.p_lang, 9)) for r in L.identify(*frames(spark, docs, pages)).collect()}
    for budget, hot in ((0, 1000), (400, 3)):
        monkeypatch.setattr(session.fits, "__defaults__", (budget,))
        monkeypatch.setattr(L, "HOT", hot)
        assert {r.page_id: (r.lang, round(r.p_lang, 9)) for r in L.identify(*frames(spark, docs, pages)).collect()} == want


def test_edge_rows(spark):
    docs, pages, _ = made(2, 60)
    odd = [(900, None, None), (901, "", ""), (902, "not a url", "<html lang=zz>" + words(random.Random(1), "bb", 100_000)), (None, pages[1][1], pages[1][2]), (1, pages[1][1], pages[1][2])]
    p, d = frames(spark, docs + [(500, "x", None, "x"), (501, None, "aa", "x"), (None, "y", "aa", "x")], pages + odd)
    got = defaultdict(list)
    for r in L.identify(p, d).collect():
        got[r.page_id].append((r.lang, r.p_lang, r.text_lang, r.declared, r.suffix))
    assert got[902][0][0] == "bb" and got[902][0][3] == "zz" and got[900][0][2] == got[901][0][2] == "und" and got[900][0][0] in SYLLABLES
    assert got[1][0] == got[1][1] == got[None][0] and sum(map(len, got.values())) == 65
    assert {(r.lang, r.p_lang) for r in L.identify(p, d.limit(0)).collect()} == {("und", None)}
    assert not L.identify(p.limit(0), d).count()
