"""Kernels against plain statements of their rules."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recallspark.llm import bpe, graph_search, impact_index, jaccard, mixing, pii, secret_scan, style_tree, toxicity
from recallspark.llm.arrow import Scratch
from recallspark.llm.components import connected, joined_by

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def encoded(texts):
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, remembered=50)
    ids = [[] for _ in texts]
    for text, part in encoder.encode(texts):
        ids[text] += part.tolist()
    return encoder, ids


def test_bpe_equals_the_public_library():
    rng = random.Random(1)
    signs = list("aeiou thn 0129 .,'é²½ª\x85\xa0\x1c\t\n") + ["日本", "한", "😀", "’s", " the", "'ll"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(800)] + ["", "a" * 3000, "ab" * 500 + " x", " \n \n"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encoder, ids = encoded(texts)
    assert ids == [own.encode_ordinary(t) for t in texts]
    assert [encoder.tokens(np.array(i, int)).decode() for i in ids] == texts


def test_scalar_and_vector_merges_agree():
    rng = random.Random(2)
    pieces = sorted((bytes(rng.choices(b"abcdeth ", k=rng.randint(1, 70))) for _ in range(300)), key=len)
    flat, counts = bpe.merge_many(pieces, bpe.Pairs(RANKS))
    assert flat.tolist() == [i for p in pieces for i in bpe.merge(p, RANKS)] and counts.sum() == len(flat)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and pii.luhn(digits(t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15),
}


def digits(text):
    return re.sub("[^0-9]", "", text)


def test_base_personal_data():
    rng = random.Random(3)
    signs = list("ab@@..-+ 0123456789()é\n") + ["4111 1111 1111 1111", "x@y.zz", "+49 (30) 1234567", "10.0.0.255", "999.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 30)))
        want = [(k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m.group())]
        want.sort(key=lambda s: (s[1], pii.KINDS.index(s[0])))
        spans = pii.find(text)
        assert [s for s in spans if s[0] in pii.BASE_KINDS] == want


def test_added_personal_data_and_mask():
    text = "IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789, ftp://me:pw@host.org/x and account no. 12345678"
    spans = pii.find(text)
    assert [s[0] for s in spans] == ["iban", "ssn", "login", "account"] or {"iban", "ssn", "account"} <= {s[0] for s in spans}
    masked = pii.mask(text, spans)
    assert "3704" not in masked and "123-45" not in masked and "12345678" not in masked
    assert pii.find("") == [] and pii.mask("plain", []) == "plain"


def test_cues_in_any_case():
    for cue, kind, value in (
        ("Social Security number: ", "ssn", "123-45-6789"), ("sOCIAL sECURITY ", "ssn", "123-45-6789"),
        ("AcCt no. ", "account", "12345678"), ("IBan ", "iban", "DE89 3704 0044 0532 0130 00"), ("tÉlÉphone ", "number", "030 1234567"),
    ):
        text = f"İİ x@y.zz {cue}{value}"
        start = len(text) - len(value)
        assert pii.find(text) == [("email", 3, 9), (kind, start, len(text))]
        assert pii.mask(text, pii.find(text)) == f"İİ [EMAIL] {cue}[{kind.upper()}]"


def test_base_secrets():
    rng = random.Random(4)
    signs = list("ab =:'\"é\n") + ["token", "API_KEY", "apikey", "Secret", "passwd", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3, "x1y2z3"]
    rules = {
        "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m.group(2)) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
    }
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 20)))
        want = [(k, *m.span()) for k, (p, ok) in rules.items() for m in p.finditer(text) if ok(m)]
        want.sort(key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert secret_scan.base_spans(text) == want


def test_secret_network_learns_and_reaches_its_recall():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) + (" token = abc123def456" if i % 5 == 0 else "") for i in range(300)]
    x, y = secret_scan.findings(texts, drawn=400)
    net = secret_scan.train(x, y, epochs=4)
    scores = net.scores(x)
    assert (scores[y == 1] >= net.threshold).mean() > 0.9 and (scores[y == 0] >= net.threshold).mean() < 0.1
    assert secret_scan.find_all(["", "nothing"], net) == [[], []]


def test_credentials_of_the_corpus_are_not_taught_as_clean():
    rng = random.Random(8)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]

    def planted(prefix, n):
        secret = prefix + "".join(rng.choices(signs, k=n - 1)) + "7"
        text = " ".join(rng.choices(words, k=20)) + f" {secret} " + " ".join(rng.choices(words, k=20))
        return text, ("learned", text.index(secret), text.index(secret) + len(secret))

    forms = [("ghp_", 36), ("sk_live_", 24), ("eyJ", 90), ("xoxb-", 40)]
    texts = [planted(*forms[i % 4])[0] for i in range(400)] + [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    x, y = secret_scan.findings(texts, drawn=400)
    assert (y == 0).sum() <= 400
    net = secret_scan.train(x, y, epochs=4)
    new = [planted(*forms[i % 4]) for i in range(100)]
    found = secret_scan.find_all([t for t, _ in new], net)
    assert sum(span in spans for (_, span), spans in zip(new, found, strict=True)) >= 95


def test_threshold_keeps_the_recall_where_scores_are_low():
    rng = np.random.default_rng(1)
    x = rng.integers(2, 60, (2000, secret_scan.encoded("", 0, 0).size))
    y = (np.arange(2000) % 10 == 0).astype(int)
    net = secret_scan.train(x, y, epochs=1)
    order = np.random.default_rng(5).permutation(2000)
    held = order[::4]
    assert net.threshold < 0.5 and (net.scores(x[held][y[held] == 1]) >= net.threshold).mean() >= 0.98


def test_toxicity_tolerates_disguise():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(800)]
    bad = ["stupid", "moronic", "wretched"]
    texts, labels = [], []
    for i in range(600):
        own = rng.choices(words, k=25)
        if i % 3 == 0:
            own[rng.randrange(25)] = rng.choice(bad)
        texts.append(" ".join(own))
        labels.append(int(i % 3 == 0))
    machine = toxicity.train(texts[:400], labels[:400])
    scores = machine.scores(texts[400:])
    truth = np.array(labels[400:])
    assert ((scores >= 0.3) == truth).mean() > 0.97
    calm = machine.scores([" ".join(words[:20])])[0]
    assert machine.scores(["so s.t.u.p.i.d here"])[0] > calm and machine.scores(["so s t u p i d here"])[0] > calm
    assert toxicity.train([], []).scores(["", "a"]).tolist() == [0.5, 0.5]


def test_schedule_keeps_every_source_within_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0.0001}
    slots = mixing.shares(weights, 1000)
    assert sum(slots.values()) == 1000 and min(slots.values()) >= 1
    order, seen = mixing.schedule(slots), dict.fromkeys(slots, 0)
    for t, source in enumerate(order, 1):
        seen[source] += 1
        assert all(abs(seen[s] - t * slots[s] / 1000) < 1 for s in slots)
    assert seen == slots


def test_shares_leave_a_slot_to_every_tiny_source():
    weights = {"hot": 999.06, "x": 0.47, "y": 0.47} | {f"t{i}": 1e-6 for i in range(50)}
    slots = mixing.shares(weights, 1000)
    assert sum(slots.values()) == 1000 and min(slots.values()) == 1 and slots["hot"] == 948
    with pytest.raises(ValueError):
        mixing.shares(weights, 52)


def test_impact_index_is_exact():
    rng = np.random.default_rng(7)
    v = rng.integers(-200, 200, (700, 12))
    v[100:140] = v[100]
    least = np.arange(700)
    index = impact_index.build_index(v, least)
    for i in range(0, 700, 35):
        rows, scores = impact_index.top(index, v[i], 6)
        want = np.lexsort((least, -(v @ v[i])))[:6]
        assert rows.tolist() == want.tolist() and scores.tolist() == (v @ v[i])[want].tolist()


def test_graph_recall_with_uneven_lengths():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    index = graph_search._build(v, np.arange(3000))
    query, row, score = graph_search._answer(96)(index, v[:100], 20)
    truth = np.argsort(-(v[:100] @ v.T), axis=1)[:, :20]
    found = [set(row[query == i]) for i in range(100)]
    assert np.mean([len(found[i] & set(truth[i])) / 20 for i in range(100)]) > 0.9
    assert np.allclose(score, (v[query] * v[row]).sum(axis=1))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>x</nav><article><header><h1>T</h1></header><p>a\n <b>b<br>c<p>d</article><footer>f", "T\n\na b c\n\nd"),
        ("<div class='ad'>x</div><p>one<p>two<form>f</form><aside>s</aside><script>var a='</p>'</script>", "one\n\ntwo"),
        ("<article><p>x</p><div id=comments><p>no</p></div></article>", "x"),
        ("<p>a</p", "a"),
        ("<" * 2000, "<" * 2000),
    ],
)
def test_main_text(page, text):
    assert style_tree.main_text(page) == text


def test_a_word_of_a_class_does_not_lose_the_article():
    text = "<p>the text of the page</p>"
    for page in (
        f"<div class='layout has-sidebar'><article>{text}</article><div class=sidebar>s</div></div>",
        f"<main class='content no-sidebar'>{text}</main>",
        f"<article class='post with-comments'>{text}<div id=comments>c</div></article>",
        f"<div id='search-results'>{text}</div><div class=ad>x</div>",
        f"<main><div class='post comments'>{text}</div></main>",
        f"<div class='widget'><div><main>{text}</main></div></div><p>outside",
        f"<div class='page-header'>h</div>{text}<div class='related'>r</div>",
        f"<article>{text}</article><div id=comments><article class=comment>c</article></div>",
    ):
        assert style_tree.main_text(page) == "the text of the page"


def test_deep_pages_do_not_fail():
    assert style_tree.main_text("<div>" * 5000 + "x") == "x"
    assert not math.isnan(len(style_tree.style_nodes("<div>" * 50 + "x")))


def test_parity_bits_never_exclude_a_link(spark):
    rng = np.random.default_rng(7)
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(universe, rng.integers(1, 300))) for _ in range(60)]
    # subsets and extensions of one another, so that many pairs lie on either side of the limit
    sets += [np.unique(np.concatenate([s[: len(s) * k // 10], universe[: rng.integers(0, 20)]])) for s in sets[:20] for k in (7, 8, 9)]
    sets = [s for s in sets if len(s)]
    bounds = np.cumsum([0] + [len(s) for s in sets])
    words = jaccard._parities(np.concatenate(sets), bounds)
    rows = [(i, len(s), *(int(words[c][i]) for c in jaccard._PARITY)) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, ["id", "n", *jaccard._PARITY])
    x, z = (table.select(*(F.col(c).alias(side + c) for c in table.columns)) for side in ("x_", "z_"))
    near = {(r.x_id, r.z_id) for r in x.join(z, F.col("x_id") < F.col("z_id")).filter(jaccard._near_in_parity("x_", "z_", 75)).collect()}
    members = [set(s.tolist()) for s in sets]
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(members[i] & members[j]) >= 75 * len(members[i] | members[j])}
    assert links and links <= near and len(near) < len(sets) * (len(sets) - 1) // 4


def test_components_grow_by_added_edges(spark):
    def components(edges: set) -> dict:
        of = {v: v for e in edges for v in e}
        for _ in of:
            for a, b in edges:
                of[a] = of[b] = min(of[a], of[b])
        return of

    rng = np.random.default_rng(3)
    scratch, known, all_edges = Scratch(spark), None, set()
    for size in (30, 0, 25, 40):
        edges = {(int(a), int(b)) for a, b in rng.integers(0, 90, (size, 2)) if a != b}
        all_edges |= edges
        frame = spark.createDataFrame(sorted(edges), "a bigint, b bigint")
        known = connected(frame, scratch) if known is None else joined_by(known, frame, scratch)
        assert {r.v: r.c for r in known.collect()} == components(all_edges)


def test_components_match_brute_force_on_near_copies_of_many_degrees(spark):
    rng = np.random.default_rng(11)
    bases = [[f"b{k}w{i}" for i in range(60)] for k in range(4)]
    rows = []
    for i in range(160):
        words = list(bases[i % 4])
        for at in rng.integers(0, 60, rng.integers(0, 6)):
            words[at] = f"x{rng.integers(0, 12)}"
        rows.append((i, " ".join(words)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    of = list(range(len(rows)))
    links = [(i, j) for i in of for j in of[:i] if 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j])]
    for _ in rows:
        for i, j in links:
            of[i] = of[j] = min(of[i], of[j])
    found = {r.doc_id: r.component_id for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(of)) and 4 < len(set(of)) < 160
