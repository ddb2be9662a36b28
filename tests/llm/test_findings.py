import hashlib
import random
import re
import time

import numpy as np
from cases import HOSTILE, hostile

from auctionflow.llm import private_data as P
from auctionflow.llm import secrets as S


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def brute_private(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (2 if i % 2 else 1)
            total += x // 10 + x % 10
        return total % 10 == 0

    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int("0" + p.lstrip("0")) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def noise(seed, alphabet, n=3000, most=60):
    random.seed(seed)
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, most))) for _ in range(n)]


def test_base_rules_by_brute_force():
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", ' = "', ":", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "a", " ", "=", "é", "x_y"]
    random.seed(7)
    for _ in range(3000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 9)))
        assert S.base_spans(t) == brute_secrets(t), t
    numbers = noise(8, "0123456789+-. ()@ax%") + ["4111 1111-1111 1111", "1.2.3.256 1.2.3.4.5 001.2.3.4 " + "9" * 5000 + ".1.1.1", "+1 (234) 555-7788", "a@b a@b.c @b.c a@b.c.d@e.f"]
    for t in numbers:
        assert P.base_spans(t) == brute_private(t), t


def check(spark, df, docs, scan, brute, kinds):
    got = sorted(scan(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(want)
    for r, (d, t) in zip(got, want):
        base = brute(t)
        assert r["doc_id"] == d and r["base_sha256"] == sha(base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in base) for k in kinds]
        spans = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert {(int(a), int(b), k) for k, a, b in spans} >= set(base)
        assert all(0 <= int(a) < int(b) <= len(t or "") for _, a, b in spans)


def test_corpus_and_hostile(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    for scan, brute, kinds in ((S.scan, brute_secrets, S.KINDS[:3]), (P.scan, brute_private, P.KINDS)):
        check(spark, df, docs, scan, brute, kinds)
        check(spark, hostile(spark), HOSTILE, scan, brute, kinds)
        assert scan(hostile(spark, [])).collect() == []


def test_gradients_by_differences():
    net = S.Network.drawn(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = np.stack(S.drawn_findings(6, 1, [])[0])
    y = np.array([0, 1, 0, 1, 0, 1.0])
    loss = lambda: float(np.sum(np.logaddexp(0, (z := net.forward(x)[0])) - y * z))
    z, cache = net.forward(x)
    g = net.gradients(1 / (1 + np.exp(-z)) - y, cache)
    rng = np.random.default_rng(0)
    for k, w in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if k == "embed":
                at = (int(x[0, 30]), at[1])
            before = w[at]
            w[at] = before + 1e-5
            up = loss()
            w[at] = before - 1e-5
            down = loss()
            w[at] = before
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3, k


def test_network_held_out():
    net = S.fit(["the of and to in is that it was for on are as with"] * 3)
    x, y = S.drawn_findings(600, 99, [])
    took = net.score(np.stack(x)) >= net.threshold
    y = np.array(y) == 1
    assert took[y].mean() > 0.9 and took[~y].mean() < 0.05
    text = "here aws_key = 9f8A+dk2LxQ/77bVnmZtR4uYw1PeSgHc0aaB done but some_long_identifier_name_2020_here is none"
    found = S.spans([text], net)[0]
    assert [text[a:b] for a, b, _ in found] == ["9f8A+dk2LxQ/77bVnmZtR4uYw1PeSgHc0aaB"]


def test_field_carries_labels_over_distance():
    field = P.fit([])
    text = "call +1 (482) 555-7163 today. " + "word " * 300 + "again (482) 555-7163 then 12 and 1999"
    found, n = P.spans(text, field)
    assert n == 1 and [text[a:b] for a, b, _ in found] == ["+1 (482) 555-7163", "(482) 555-7163"]
    assert P.spans("in 1999 there were 12 of 345 and 2.5", field) == ([], 0)
    assert P.masked(text, found).startswith("call [PHONE] today. word ")


def test_beliefs_are_exact_on_a_chain():
    field = P.fit([], drawn=60, steps=50)
    g = P.graph("+1 (482) 555-7163 9")
    assert len(g.spans) == 4 and len(g.chain) == 3 and not len(g.skip)
    z = g.features @ field.node
    joint = {}
    labels = range(P.NONE + 1)
    for a in labels:
        for b in labels:
            for c in labels:
                for d in labels:
                    joint[a, b, c, d] = np.exp(z[0, a] + z[1, b] + z[2, c] + z[3, d] + field.chain[a, b] + field.chain[b, c] + field.chain[c, d])
    total = sum(joint.values())
    for i in range(4):
        exact = [sum(v for k, v in joint.items() if k[i] == x) / total for x in labels]
        assert np.abs(exact - field.beliefs(g)[i]).max() < 0.02


def test_evidence_crosses_a_group_of_100():
    n, labels = 100, P.NONE + 1
    features = np.zeros((n, 1))
    features[0] = 1.0
    field = P.Field(np.array([[0, 0, 0, 10.0, 0]]), np.zeros((labels, labels)), 6 * np.eye(labels))
    g = P.Graph([(i, i + 1) for i in range(n)], features, np.zeros((0, 2), np.int64), np.array([(i, i + 1) for i in range(n - 1)]))
    exact = np.exp(features @ field.node)  # on a chain whose other nodes know nothing, forward messages are all there is
    for i in range(1, n):
        exact[i] = exact[i - 1] / exact[i - 1].sum() @ np.exp(field.skip)
    exact /= exact.sum(axis=1, keepdims=True)
    assert exact[-1, 3] > 0.4 and np.abs(exact - field.beliefs(g)).max() < 0.01


def test_number_repeated_100_times():
    text = "call +1 (482) 555-7163 today. " + "again (482) 555-7163 then. " * 100
    found, n = P.spans(text, P.fit([]))
    assert n == 100 and {text[a:b] for a, b, _ in found} == {"+1 (482) 555-7163", "(482) 555-7163"}


def test_secrets_anywhere_in_a_run():
    key = "9f8A+dk2LxQ77bVnmZtR4uYw1PeSgHc0aaB"
    for text in ("PRODUCTION_DATABASE_REPLICA_MASTER_CREDENTIAL=" + key, "/usr/share/configuration/production/database/replica/" + key, "x" * 60 + key + "y" * 60):
        a = text.index(key)
        whole = (0, len(text))
        assert whole in S.candidates(text, [])
        assert (a, a + len(key)) in S.candidates(text, []) or "=" not in text
        # every character is in the inner part of some window
        seen = set()
        for at, w in zip([*range(0, max(0, len(text) - S.INSIDE), S.STRIDE), max(0, len(text) - S.INSIDE)], S.windows(text, *whole)):
            assert (w == S.window(text, at, len(text))).all()
            seen |= set(range(at, min(len(text), at + S.INSIDE)))
        assert seen == set(range(len(text)))
    assert S.candidates("pwd hunter2xyz9Q", []) == [(4, 16)]
    net = S.fit(["the of and to in is that it was for on are as with"] * 3)
    text = "PRODUCTION_DATABASE_REPLICA_MASTER_CREDENTIAL=" + key
    assert any(b == len(text) for _, b, _ in S.spans([text], net)[0])
    assert S.spans(["in section12 of the report-2019 see table144 and chapter7"], net) == [[]]


def test_threshold_holds_the_recall():
    net = S.Network.drawn(2)
    x, y = (np.array(v) for v in S.drawn_findings(400, 5, []))
    net.train(x, y.astype(float))
    worst = y.astype(float)
    worst[net.forward(x)[0].argmax()] = 0  # one wrong label at the very top
    kind = np.where(np.arange(len(y)) % 4 == 1, "a", "b")
    net.calibrate(x, worst, 0.98, kind)
    took = net.score(x) >= net.threshold
    for k in "ab":
        assert took[(worst == 1) & (kind == k)].mean() >= 0.98
    assert net.recall >= 0.98 and abs(net.precision - worst[took].mean()) < 1e-9
    found = S.spans(["pwd hunter2xyz9Q"], S.fit(["the of and to in is that it was for on are as with"] * 3))
    assert found == [[(4, 16, "model")]]


def test_long_tokens_are_read_whole():
    text = "語" * 300 + "(482)555-7163" + "語" * 300 + "(482)555-7163"
    g = P.graph(text)
    assert [text[a:b] for a, b in g.spans] == ["(482)555-7163"] * 2 and g.skip.tolist() == [[0, 1]]
    assert not len(P.graph("1" + "a" * 250 + "x 1" + "a" * 250 + "y").skip)


def test_planted_kinds_that_training_never_saw(spark):
    """Secrets outside the base rules, in the operator's own output; the generator of training findings draws none of these kinds."""
    rng = random.Random(4)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    kinds = [
        lambda: "ghp_" + run(alnum, 36), lambda: "xoxb-" + run("0123456789", 12) + "-" + run(alnum, 24), lambda: "npm_" + run(alnum, 36), lambda: "AIza" + run(alnum + "-_", 35),
        lambda: "eyJ" + run(alnum, 20) + ".eyJ" + run(alnum + "-_", 60), lambda: run("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), lambda: run(alnum + "+/", 86) + "==",
    ]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").limit(350)
    planted, texts = {}, []
    for i, r in enumerate(df.collect()):
        value, t = kinds[i % len(kinds)](), r["text"]
        at = t.find(" ", len(t) // 2)
        lead = t[: max(at, 0)] + rng.choice([" key ", " use ", " cred: ", " "])
        planted[i] = (len(lead), len(lead) + len(value))
        texts.append((i, lead + value + " " + t[max(at, 0) :]))
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    hit = 0
    for i, (a, b) in planted.items():
        spans = [x.split(":") for x in got[i]["spans"].split(",") if x]
        hit += any(int(s) < b and a < int(e) for _, s, e in spans)
        assert got[i]["base_sha256"] == sha(brute_secrets(texts[i][1]))
    assert hit >= 0.9 * len(planted) and sum(r["n_model"] for r in got.values()) <= 1.3 * len(planted)


def test_recall_of_each_kind(sf_dir):
    """Kinds that training draws, by themselves, in contexts of prose and of credentials: UUIDs, short passwords, passwords with signs; few findings in texts without secrets."""
    import pyarrow.parquet as pq

    docs = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    network = S.fit(docs[:600])
    rng = random.Random(9)
    run = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))

    def password(n, signs=""):
        while True:
            body = run(alnum + signs, n)
            if re.search("[0-9]", body) and re.search("[A-Za-z]", body) and body[0] in alnum and body[-1] in alnum and (not signs or re.search(r"[!@#$%&*?]", body)):
                return body

    kinds = {"uuid": lambda: "-".join(run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), "8": lambda: password(8), "12": lambda: password(12), "signs 10": lambda: password(10, "!@#$%&*?"), "signs 14": lambda: password(14, "!@#$%&*?")}
    for name, make in kinds.items():
        hit = 0
        for i in range(120):
            t, value = docs[i * 3][:600], make()
            at = max(t.find(" ", len(t) // 2), 0)
            lead = t[:at] + rng.choice([" key ", " use ", " cred: ", " login ", " pwd=", " "])
            found = S.spans([lead + value + " " + t[at:]], network)[0]
            hit += any(a < len(lead) + len(value) and len(lead) < b for a, b, _ in found)
        assert hit >= 0.9 * 120, (name, hit)
    added = [t[a:b] for t, found in zip(docs[600:], S.spans(docs[600:], network)) for a, b, k in found if k == "model"]
    assert len(added) <= 2, added
    mails = "write to user89@mail7.example.com or a1b2@mail3.org now " * 3
    assert not [c for c in S.candidates(mails, S.base_spans(mails)) if "@" in mails[slice(*c)]]


def test_candidates_among_many_findings():
    text = "token=abcdef12 " * 20_000 + "q1w2e3r4t5"
    began = time.perf_counter()
    assert S.candidates(text, S.base_spans(text)) == [(len(text) - 10, len(text))]
    assert time.perf_counter() - began < 3


def test_plainly_none():
    words = {"section", "report"}
    assert S.plainly_none("section12-report", words) and S.plainly_none("aaaa1111aaaa", words) and not S.plainly_none("sectionq1xzyw7k", words)


def brute_findings(text, nodes, kind):
    """All ways to cut nodes into whole numbers and left-over nodes; the fewest digits left over, then the most numbers."""
    count = lambda a, b: sum(c.isdigit() for c in text[a:b])
    best = None

    def go(i, left, found):
        nonlocal best
        if i == len(nodes):
            if best is None or (left, -sum(whole for _, _, whole in found)) < best[0]:
                best = (left, -sum(whole for _, _, whole in found)), found
            return
        go(i + 1, left + count(*nodes[i]), [*found, (*nodes[i], False)])
        for j in range(i, len(nodes)):
            if P._fits(kind, text[nodes[i][0] : nodes[j][1]]):
                go(j + 1, left, [*found, (nodes[i][0], nodes[j][1], True)])

    go(0, 0, [])
    return best[0]


def test_neighbouring_numbers_stay_apart():
    """Equal and unequal numbers of each kind next to each other: a span each, with its own ends."""
    field = P.fit([])
    card, other = "4465758382889437", "4111111111111111"
    for numbers in ([card, card], [card, other], [card] * 4000, [other, card, other], ["(663) 555-6869"] * 2, ["(663) 555-6869", "(212) 555-0100", "(415) 555-0188"], ["1.2.3.4", "5.6.7.8", "1.2.3.4"], ["a@b.co", "a@b.co", "c@d.org"]):
        for join in (" ", ", "):
            text, at = "so " + join.join(numbers) + " end", []
            place = 3
            for x in numbers:
                at.append((place, place + len(x)))
                place += len(x) + len(join)
            found, _ = P.spans(text, field)
            assert sorted((a, b) for a, b, _ in found) == at, (numbers[:3], [text[a:b] for a, b, _ in found][:4])
            assert "".join(sorted({k for _, _, k in found})) in ("card", "phone", "ip", "email")
    random.seed(11)
    for _ in range(300):
        kind = random.choice(["card", "phone"])
        parts = [random.choice([card, other, card[:8], card[8:], "(663)", "555-6869", "+1", "12", "123456789"]) for _ in range(random.randint(1, 7))]
        text, nodes, place = " ".join(parts), [], 0
        for x in parts:
            nodes.append((place, place + len(x)))
            place += len(x) + 1
        got = P._findings(text, nodes, P.KINDS.index(kind))
        whole = [s for s in got if P._fits(kind, text[s[0] : s[1]])]
        covered = sum(c.isdigit() for a, b, _ in whole for c in text[a:b])
        assert (sum(c.isdigit() for c in text) - covered, -len(whole)) == brute_findings(text, nodes, kind), (kind, text, got)
        assert got == sorted(got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_cards_next_to_each_other_in_the_query(spark):
    """The two documents of the sample whose neighbouring cards became one span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in P.scan(docs).where("doc_id in (254, 402)").collect():
        assert r["spans"].count("card:") == 2 and r["n_card"] == 0
