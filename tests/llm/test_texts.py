"""Token counts, personal data, toxicity, quotations and mixing on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cubewright.llm import mixing, pii, quotes, tokencount, toxicity

from .test_dedup import documents

ODD = [None, "", " ", "I'm you're 12 １２ 𝔘nicode 😀", "<|startoftext|> hi <|endoftext|>a<|endoftext|>", "İSTANBUL ÀÉ ß ΑΣ", "é x​", "\x1c\x85a b", "中文 日本語", "don'T it'LL 's", "a" * 5000, "word " * 60_000, "<|", "\ua7cb \ua7dc x\ua7cb"]


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abe éß 12.,'\n<|>中😀") for _ in range(rng.randrange(200))) for _ in range(200)]
    library = Tokenizer.from_file(path)
    got = tokencount.token_counts(documents(spark, texts), path).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(library.encode(text, add_special_tokens=False).ids), len(text.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert len(got) == len(texts) and tokencount.token_counts(documents(spark, texts).limit(0), path).count() == 0


def test_merging_order():
    # ranks: bc before ab, then a+bc
    assert tokencount.merged_size(3, [0, 1, 2], {(1, 2): (0, 9), (0, 1): (1, 8), (0, 9): (2, 7)}) == 1
    assert tokencount.merged_size(4, [0, 0, 0, 0], {(0, 0): (0, 5)}) == 2
    assert tokencount.merged_size(5, [0, 0, 0, 0, 0], {(0, 0): (0, 5), (5, 5): (1, 6)}) == 2


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(s):
    digits = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def brute_base(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in s.split(".")),
        "card": lambda s: 13 <= sum(c.isdigit() for c in s) <= 19 and plain_luhn(s),
        "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, r in BASE.items() for m in r.finditer(text or "") if ok[k](m.group())]


def test_personal_data(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c@d.e @@x@y..z", "1.2.3.4.5.6.7.8 256.1.1.1 0000000.1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (523) 555-1055 x +12", "9" * 20_000 + ".1.1.1", "call 555-123-4567 phone", "ssn 123-45-6789 here", "write to john at mail dot com", "Dear Mr. John Smith, regards"]
    texts += ["".join(rng.choice("ab@.+ 0123456789()-%") for _ in range(300)) for _ in range(150)]
    got = pii.find(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(filter(None, r["spans"].split(",")))
    added = {r["doc_id"]: r["spans"] for r in got if r["n_added"]}
    assert any("phone" in added.get(7, "") or "id" in added.get(8, "") or "name" in added.get(10, "") for _ in [0]) and added
    assert pii.find(documents(spark, texts).limit(0)).count() == 0
    assert pii.find(documents(spark, ["plain words only"])).first()["spans"] == ""


def test_labelers_are_weighed():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    rates = [(0.9, 0.1), (0.8, 0.3), (0.7, 0.4)]
    votes = np.stack([np.where(truth, rng.random(4000) < h, rng.random(4000) < m) for h, m in rates], axis=1).astype(int)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    share, hit, miss = pii.estimate([(tuple(map(int, r)), int(c)) for r, c in zip(rows, counts)])
    assert abs(share - 0.4) < 0.12 and hit[0] > hit[2] and miss[0] < miss[2]


def test_reliabilities_against_brute_force():
    """EM over single candidates in plain loops, with the same beginning and the same smoothing."""
    rng = random.Random(3)
    votes = [tuple(rng.choice([-1, 0, 1, 1]) for _ in range(3)) for _ in range(400)]
    share, hit, miss = 0.5, [0.8] * 3, [0.2] * 3
    for _ in range(50):
        q = []
        for v in votes:
            yes, no = share, 1 - share
            for j, x in enumerate(v):
                if x >= 0:
                    yes, no = yes * (hit[j] if x else 1 - hit[j]), no * (miss[j] if x else 1 - miss[j])
            q.append(yes / (yes + no))
        share = min(0.98, max(0.02, sum(q) / len(q)))
        hit = [(sum(p for p, v in zip(q, votes) if v[j] == 1) + 1.6) / (sum(p for p, v in zip(q, votes) if v[j] >= 0) + 2) for j in range(3)]
        miss = [(sum(1 - p for p, v in zip(q, votes) if v[j] == 1) + 0.4) / (sum(1 - p for p, v in zip(q, votes) if v[j] >= 0) + 2) for j in range(3)]
    got = pii.estimate([(v, votes.count(v)) for v in sorted(set(votes))])
    assert abs(got[0] - share) < 1e-6 and np.allclose(got[1], hit, atol=1e-6) and np.allclose(got[2], miss, atol=1e-6)


def test_secrets_are_found(spark):
    rng = random.Random(5)
    key = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    texts = [f'words token = "{key(40)}" more words' for _ in range(60)] + [f"password: {key(12, 'abcXYZ019_')}9 and on" for _ in range(20)]
    clean = ["plain words without any of it, key ideas: nothing", "a_long_name_of_something_without_digits = 3", "number 12345678901234567890123 only"] * 20
    got = {r["doc_id"]: r for r in pii.find(documents(spark, texts + clean)).collect()}
    assert sum(got[i]["n_secret"] for i in range(60)) == 60 and sum(got[i]["n_secret"] for i in range(60, 80)) >= 18
    assert all(got[i]["n_secret"] == got[i]["n_spans"] == 0 for i in range(80, 140))
    assert got[0]["spans"] == "secret:15:55"


def test_every_span_is_voted_on(spark, monkeypatch):
    """Base spans of all kinds, names without a title, obfuscated addresses and cut card numbers are candidates."""
    texts = ["mail a@b.com", "login from 10.1.2.3 and 10[.]1[.]2[.]4", "visa 4111 1111 1111 1111 then 4111 1111 1111 1111 12", "phone +1 (523) 555-1055", "ssn 123-45-6789"]
    texts += ["yesterday Peter Miller came", "a contract signed Ada Lovelace here", "xPeter Miller by Peter Brown"]
    spans = lambda t: [f"{k}:{t[a:b]}" for k, a, b in pii.candidates(t, pii.base_spans(t))]
    assert [spans(t) for t in texts] == [
        ["email:a@b.com"], ["ip:10.1.2.3", "ip:10[.]1[.]2[.]4"], ["card:4111 1111 1111 1111", "card:4111 1111 1111 1111"], ["phone:+1 (523) 555-1055"],
        ["id:123-45-6789"], ["name:Peter Miller"], ["name:Ada Lovelace"], ["name:Peter Brown"],
    ]
    seen, fit = [], pii.fit_classifier
    monkeypatch.setattr(pii, "fit_classifier", lambda x, q, n: seen.append(n.sum()) or fit(x, q, n))
    rows = pii.find(documents(spark, texts * 20)).collect()
    assert seen == [200] and all(r["n_added"] >= 0 and set(brute_base(texts[r["doc_id"] % 8])) <= set(r["spans"].split(",")) for r in rows)
    assert any("name" in r["spans"] for r in rows if r["doc_id"] % 8 == 5)


def test_all_candidates_fit_the_classifier(spark, monkeypatch):
    """Two kinds of over 20,000 equal candidates each: both are seen, with their counts."""
    texts = ["passport 123-45-6789 of\n" * 21_000, "Dear Mrs. Smith and\n" * 21_000, "ssn 923-45-6789 x"]
    seen, fit = [], pii.fit_classifier
    monkeypatch.setattr(pii, "fit_classifier", lambda x, *more: seen.append((x, *more)) or fit(x, *more))
    pii.find(documents(spark, texts)).count()
    (x, _, n), kinds = seen[0], list(pii.KINDS)
    assert n.sum() == 42_001
    assert {k: n[x[:, 1 + kinds.index(k)] == 1].sum() for k in ("id", "name")} == {"id": 21_001, "name": 21_000}


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiourtnslm") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        if bad := i % 4 == 0:
            for _ in range(max(2, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "worthless", "moronic"])
        out.append((" ".join(words), int(bad)))
    return out


def test_toxicity(spark):
    corpus = toxic_corpus(600, 1)
    texts = [t for t, _ in corpus] + [None, "", "scumbags worthles moronik " * 3, "x " * 50_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(corpus)] + [(3, None, None), (9999, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in range(600) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == corpus[i][1] for i in held) / len(held) > 0.95
    assert got[602]["predicted"] == 1 and got[600]["score"] == got[601]["score"]  # unseen misspellings; empty texts
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert none.where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    corpus = toxic_corpus(200, 2)
    docs = documents(spark, [t for t, _ in corpus])
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    a, b = (spark.createDataFrame([(i, f(i, y)) for i, (_, y) in enumerate(corpus)], "doc_id long, toxic int") for f in (lambda i, y: y, flip))
    assert np.array_equal(toxicity.train(docs, a, steps=20).value, toxicity.train(docs, b, steps=20).value)


def test_toxic_rows_are_told_by_their_text(spark):
    """Repeated and null ids, a repeated labelled id, and the byte bound of the fit."""
    corpus = toxic_corpus(400, 3)
    bad, good = (next(t for t, y in corpus if y == k) for k in (1, 0))
    rows, ids = [t for t, _ in corpus] + [bad, good, bad, good, None], [*range(400), 1, 1, None, None, None]
    docs = documents(spark, rows, ids)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels, steps=60)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns
    model = toxicity.train(docs, labels, steps=60)
    want = [(i, t) for i, t, s in zip(ids, rows, model.scores(rows, {})) if s < toxicity.THRESHOLD]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert toxicity.train(docs, labels, steps=5, max_bytes=50_000).value.any()
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


CONV = "conv_id long, turn long, role string, text string, c long, root_conv string"


def test_quotations(spark):
    first = "Hello there, this is my first long message.\nIt has two lines."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", "Fine, and here is a second paragraph of words.\n\nAnother one that stands alone here."),
        (2, 0, "user", "On Monday X wrote:\n> Hello there, this is my FIRST\n> long message. It has two lines.\n\nI agree with all of that."),
        (3, 0, "user", ">> Hello there, this is my first long message. It has two lines.\n> I agree with all of that.\nno way at all, my friend"),
        (3, 1, "user", "> no way at all, my friend\n> > unknown words that nobody has ever said\nyes"),
        (4, 0, "user", None), (4, 1, "user", ""), (4, 2, "user", "> nobody said these words anywhere at all\nnew"), (None, 1, "user", "> " + first), (5, None, "user", "x"),
        (6, 0, "user", "> I agree with all of that.\nsame"), (6, 0, "user", "> I agree with all of that.\nsame"), (7, 0, "user", "> hi\nshort quotes link nothing"), (8, 0, "user", "\n".join(f"line {i}" for i in range(5000))),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df).collect()}
    assert quotes.conversations(df).count() == len(rows)
    reply = {k: (r["reply_to_conv"], r["reply_to_turn"], r["thread_conv"], r["thread_turn"], r["depth"]) for k, r in got.items()}
    assert reply[2, 0] == (1, 0, 1, 0, 1) and reply[3, 0] == (2, 0, 1, 0, 2) and reply[3, 1] == (3, 0, 1, 0, 3) and reply[6, 0] == (2, 0, 1, 0, 2)
    assert reply[1, 0] == (None, None, 1, 0, 0)  # a thread's first message has the thread's own key
    assert all(reply[k] == (None, None, k[0], None, 0) for k in [(1, 1), (4, 0), (4, 2), (7, 0), (8, 0)])
    order = [(r["conv_id"], r["turn"]) for r in sorted(quotes.conversations(df).collect(), key=lambda r: r["reply_order"]) if (r["thread_conv"], r["thread_turn"]) == (1, 0)]
    assert order == [(1, 0), (2, 0), (3, 0), (6, 0), (6, 0), (3, 1)]
    assert got[2, 0]["text"] == "I agree with all of that." and got[3, 1]["text"] == "yes" and got[1, 0]["text"] == first and got[4, 0]["text"] == "" and got[4, 2]["text"] == "new"
    assert quotes.conversations(df.limit(0)).count() == 0
    assert not any(x in quotes.conversations(df)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "MapInArrow", "Cartesian"))


def test_quotations_of_the_own_conversation_come_first(spark):
    words = "This paragraph stands in more than one conversation."
    rows = [(1, 0, words), (2, 0, "Other words to begin with."), (2, 1, words), (2, 2, f"> {words}\nindeed"), (3, 0, f"> {words}\nfrom elsewhere"), (4, 0, "yes"), (4, 1, "> yes\nno"), (5, 0, "> yes\nnot from there"), (6, 0, f"> {words}\nbefore"), (6, 1, words)]
    df = spark.createDataFrame([(c, t, "user", x, 1, "x") for c, t, x in rows], CONV)
    got = {(r["conv_id"], r["turn"]): (r["reply_to_conv"], r["reply_to_turn"]) for r in quotes.conversations(df).collect()}
    assert got[2, 2] == (2, 1) and got[3, 0] == (1, 0) and got[4, 1] == (4, 0) and got[5, 0] == (None, None) and got[6, 0] == (1, 0)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["en", "de", None]), rng.choice(["hot"] * 6 + ["a", "b"]), 0, "p", 1, "k") for i in range(3000)] + [(5000, None, "en", "a", 0, "p", 1, "k"), (5001, "w", "en", "a", 0, "p", 1, "k"), (5001, "w", "en", "a", 0, "p", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, of_source string, tokens int, probability string")
    target = {"source": {"hot": 0.4, "a": 0.3, "b": 0.3}}
    got = mixing.probabilities(df, target).toPandas()
    assert len(got) == len(rows) and got.probability.max() == 1 and (got.probability > 0).all()
    mass = (got.n_tokens * got.probability).groupby(got.source).sum()
    assert np.allclose(mass / mass.sum(), [0.3, 0.3, 0.4], atol=1e-3)
    by_lang, tokens = (got.n_tokens * got.probability).groupby(got.lang.fillna("")).sum(), got.n_tokens.groupby(got.lang.fillna("")).sum()
    want = (tokens / tokens.sum()) ** mixing.TEMPER
    assert np.allclose(by_lang / by_lang.sum(), want / want.sum(), atol=1e-3)
    for _, cell in got.groupby(["source", "topic"]):
        assert abs(cell.sampled.mean() - cell.probability.mean()) < 0.12 or len(cell) < 60
    assert [r["n_tokens"] for r in mixing.probabilities(df).where("doc_id = 5000").collect()] == [0]
    sample = mixing.mixed(df, target)
    assert sample.columns == [*df.columns, *mixing.ADDED] and sample.count() == got.sampled.sum()
    again = mixing.mixed(sample, target)
    assert again.columns == sample.columns and again.count() <= sample.count()
    assert mixing.probabilities(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def brute_rake(cells, targets):
    """cells: {(source, lang, topic): tokens} -> weights; every marginal in turn, many rounds."""
    total = sum(cells.values())
    weight = {c: t / total for c, t in cells.items()}
    sums = lambda k: {v: sum(w for c, w in weight.items() if c[k] == v) for v in {c[k] for c in cells}}
    want = []
    for k, by in enumerate(mixing.DIMENSIONS):
        given = targets.get(by)
        share = {v: given.get(v, s) if given else s**mixing.TEMPER for v, s in sums(k).items()}
        want.append({v: s / sum(share.values()) for v, s in share.items()})
    for _ in range(300):
        for k in range(3):
            now = sums(k)
            weight = {c: w * want[k][c[k]] / now[c[k]] if now[c[k]] else 0.0 for c, w in weight.items()}
    return weight


@pytest.mark.parametrize("small", [True, False])
def test_mixing_against_brute_force(spark, monkeypatch, small):
    """Raked probabilities, draws and the stage; null and repeated ids, rows drawn each by their text."""
    if not small:
        monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    rng = random.Random(16)
    rows = [(rng.choice([None, 7, i]) if i % 9 == 0 else i, f"{'1 2 ' * rng.randrange(3)}t{i} " + "w " * rng.randrange(40), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", None]), 1, "k", 1, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string, weight int, draw string")
    target = {"source": {"hot": 0.2, "a": 0.5, "nobody": 0.9}}
    got = mixing.probabilities(df, target).collect()
    cells = {}
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] = cells.get((r["source"], r["lang"], r["topic"]), 0) + r["n_tokens"]
    weight = brute_rake(cells, target)
    most = max(weight[c] / t for c, t in cells.items() if t)
    assert all(abs(r["probability"] - weight[c] / cells[c] / most) < 3e-3 for r in got for c in [(r["source"], r["lang"], r["topic"])] if cells[c])
    text = {t for _, t, *_ in rows}
    kept = [(r["doc_id"], r["text"]) for r in mixing.mixed(df, target).collect()]
    assert len(text) == len(rows) and len(kept) == len(set(kept)) == sum(r["sampled"] for r in got) and set(kept) <= {(i, t) for i, t, *_ in rows}
    plan = mixing.mixed(df, target)._jdf.queryExecution().executedPlan().toString() + mixing.probabilities(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow"))


def test_contradicting_targets_end(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("a", "y", "t", 1), ("b", "x", "t", 4)], "source string, lang string, topic string, tokens long")
    spread = mixing.rake(cells, {"source": {"a": 0.1, "b": 0.9}, "lang": {"x": 0.1, "y": 0.9}}).toPandas()
    assert abs(spread.weight.sum() - 1) < 1e-9
    assert mixing.rake(cells.limit(0)).count() == 0


def test_tokens_and_topics(spark):
    texts = [None, "", " a\tb \n c ", "%%% $$$ ### &&&", "1 2 3 4 5", "x" * 5000, "a\nb\nc\nd"]
    rows = documents(spark, texts).select(mixing.tokens_of(mixing.F.col("text")), mixing.topic_of(mixing.F.col("text"))).collect()
    assert [r[0] for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [r[1] for r in rows][3:] == ["symbols", "figures", "long prose", "lines"]


def brute_links(rows, min_chars):
    """conv_id, turn, text -> (reply_to, root, depth): every passage against every earlier message."""

    def level(line):
        return re.match(r"[\s>]*", line).group().count(">") if re.match(r"\s*>", line) else 0

    def passages(text):
        out, before, lines = [], None, (text or "").split("\n")
        for i, line in enumerate(lines):
            n = level(line)
            body = re.sub(r"^[\s>]+", "", line) if n else line
            if n == 0 and re.match(r"(?i)\s*(on|am|le|el)\b.*\bwrote\s*:\s*$", body) and i + 1 < len(lines) and level(lines[i + 1]):
                body = ""
            if not body.strip():
                before = None
            elif before == n:
                out[-1][1].append(body)
            else:
                out.append((n, [body]))
                before = n
        return [(n, " ".join(" ".join(b).lower().split())) for n, b in out]

    sha_of = lambda t: hashlib.sha256((t or "").encode()).digest()
    own = [(c, t, sha_of(x), {p for n, p in passages(x) if n == 0}) for c, t, x in rows]
    to = {}
    for c, t, x in rows:
        best = None
        for n, p in passages(x):
            if not n:
                continue
            same = [(a, b, d) for a, b, d, said in own if p in said]
            # The conversation's first with these words, if it is earlier; else the first of all.
            near = min((k for k in same if k[0] == c), default=None)
            if near is not None and near[:2] < (c, t):
                hit = near
            elif len(p) >= min_chars and same and min(same)[:2] < (c, t):
                hit = min(same)
            else:
                continue
            key = (n, -hit[0], -hit[1], hit[2])
            best = key if best is None else min(best, key)
        if best:
            to[c, t, sha_of(x)] = (-best[1], -best[2], best[3])
    out = {}
    for c, t, x in rows:
        at, depth = (c, t, sha_of(x)), 0
        while at in to:
            at, depth = to[at], depth + 1
        out[c, t, x] = (to.get((c, t, sha_of(x)), (None, None))[:2], at[:2], depth)
    return out


@pytest.mark.parametrize("min_chars", [quotes.MIN_CHARS, 0])
def test_threads_against_brute_force(spark, min_chars):
    """A generated corpus: re-wrapped, nested and short quotations, attributions, shared openings, repeated keys."""
    rng = random.Random(21)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    said, rows = [], []
    for c in range(40):
        for t in range(rng.randrange(1, 6)):
            lines = []
            if said and rng.random() < 0.7:
                for depth in range(1, rng.choice([1, 1, 2]) + 1):
                    quote = rng.choice(said[-25:]).split()
                    cut = rng.randrange(1, len(quote) + 1)
                    if rng.random() < 0.3:
                        lines += ["On Monday, " + "x" * rng.choice([3, 300]) + " wrote:"]
                    lines += [">" * depth + " " + " ".join(part).upper() for part in (quote[:cut], quote[cut:]) if part]
            mine = rng.choice(["yes", "no way", "thanks a lot", *[" ".join(word() for _ in range(rng.randrange(4, 12))) for _ in range(4)]])
            said.append(mine)
            lines += ["", mine] if rng.random() < 0.5 else [mine]
            rows.append((c, t, "\n".join(lines)))
            if rng.random() < 0.1:
                rows.append((c, t, "other words of the same turn " + word()))
    df = spark.createDataFrame([(c, t, "user", x, 1, "x") for c, t, x in rows], CONV).repartition(3)
    want = brute_links(rows, min_chars)
    got = quotes.conversations(df, min_chars).collect()
    linked = {}
    for (c, t, _), ((rc, rt), (oc, ot), depth) in want.items():
        linked.setdefault((c, t), []).append((rc, rt, oc if depth else c, ot if depth else t, depth))
    made = {}
    for r in got:
        made.setdefault((r["conv_id"], r["turn"]), []).append((r["reply_to_conv"], r["reply_to_turn"], r["thread_conv"], r["thread_turn"] if r["thread_turn"] is not None else r["turn"], r["depth"]))
    assert {k: sorted(map(str, v)) for k, v in made.items()} == {k: sorted(map(str, v)) for k, v in linked.items()}
    assert len(got) == len(rows) and sum(d > 0 for v in linked.values() for *_, d in v) > 30 and max(d for v in linked.values() for *_, d in v) > 2
    by = {(r["conv_id"], r["turn"]): r["reply_order"] for r in got}
    assert len({r["reply_order"] for r in got}) == len(got)
    assert all(by[r["reply_to_conv"], r["reply_to_turn"]] < r["reply_order"] for r in got if r["depth"] and [(r["reply_to_conv"], r["reply_to_turn"]) in by and len(made[r["reply_to_conv"], r["reply_to_turn"]]) == 1] == [True])
