"""The registered queries on the smallest tables: SQL where it can express them, brute force where not."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomline.llm import cotraining, flac, latent, packing, queries, secrets, tokens, urls
from tests.llm.test_operators import brute_guess


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT * FROM documents").df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, data, duck, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())


def test_op1_equals_counting(spark, data, docs):
    encode = tokens.encoder_of(tokens.load_vocabulary(tokens.TOKENIZER_PATH)).encode_ordinary
    expected = Counter()
    for t in docs.itertuples():
        if t.text.split():
            for version, n in (("byte_bpe_50k", len(encode(t.text))), ("words-1", len(t.text.split()))):
                expected.update({(t.source, t.lang, version, "d"): 1, (t.source, t.lang, version, "t"): n, (t.source, t.lang, version, "b"): len(t.text.encode())})
    got = Counter()
    for r in queries.op1_token_rollup(spark, data).collect():
        got.update({(*r[:3], "d"): r["n_docs"], (*r[:3], "t"): r["n_tokens"], (*r[:3], "b"): r["n_bytes"]})
    assert got == expected


def test_op2_guess_spans_equal_brute_force(spark, data, docs, tmp_path):
    """Each document with a value of its own words, digits and hash in credential context, by trying all segmentations."""
    words = secrets.word_ranks(tokens.load_vocabulary(tokens.TOKENIZER_PATH))

    def value(i, text):
        w, h = text.split() or ["none"], hashlib.md5(text.encode()).hexdigest()
        return (w[0] + w[-1], w[0] + "2019", h[:14], w[0][:4] * 3, "".join(c for c in h if c.isalpha())[:12] or "abcdef")[i % 5]

    planted = docs.assign(text=[f"{t} password: {value(i, t)}" for i, t in enumerate(docs.text)])
    planted.to_parquet(tmp_path / "documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, str(tmp_path)).collect()}
    counts = Counter()
    for t in planted.itertuples():
        judged = [(m.start(1), m.end(1), brute_guess(m.group(1), words) >= 8) for m in secrets.CONTEXT.finditer(t.text)]
        counts.update(kept for *_, kept in judged)
        expected = {f"guess:{i}:{j}" for i, j, kept in judged if kept}
        assert {s for s in got[t.doc_id]["spans"].split(",") if s.startswith("guess")} == expected and got[t.doc_id]["n_guess"] == len(expected)
    assert min(counts[True], counts[False]) > 20, counts


def test_op2_equals_plain_patterns(spark, data, docs):
    got = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, data).collect()}
    for t in docs.itertuples():
        spans = [(m.start(), "assign", m.end()) for m in secrets.ASSIGN.finditer(t.text) if len(m.group(2)) >= 6]
        spans += [(m.start(), "access", m.end()) for m in secrets.ACCESS.finditer(t.text) if len(m.group()) >= 20]
        spans += [(m.start(), "hex", m.end()) for m in secrets.HEX.finditer(t.text) if len(m.group()) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[1]))))
        assert got[t.doc_id]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(got[t.doc_id]["spans"].split(","))


def test_op3_reads_back_what_was_stored(spark, data, docs):
    for r in queries.op3_flac_media(spark, data).collect():
        raw = docs.text[docs.doc_id == r["doc_id"]].iloc[0].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        x = [b - 128 for b in payload]
        changes, moved = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False)), sum(abs(a - b) for a, b in zip(x, x[1:], strict=False))
        blocks = -(-len(payload) // flac.BLOCK)
        assert r["feature"] == f"energy={sum(v * v for v in x)};peak={max(map(abs, x))};sign_changes={changes};variation={moved};blocks={blocks}"
        stream = flac.encode_many([payload])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())


def test_op4_scores_labelled_rows(spark, data, duck):
    got = queries.op4_quality_cotraining(spark, data).toPandas().merge(duck.execute("SELECT * FROM labels").df(), on="doc_id")
    assert ((got.p_quality >= 0.5) == (got.quality == 1)).mean() > 0.9
    assert got.keep[got.quality == 1].mean() > 0.97


def test_op4_scores_rows_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("the driver's tables are not here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    # Rows to test on are neither labelled nor in the pool while the model is fitted.
    model = cotraining.fit(docs.where("doc_id % 3 != 0"), labels.where("doc_id % 3 != 0"))
    got = cotraining.score_documents(docs.where("doc_id % 3 = 0"), model).join(labels, "doc_id").toPandas()
    assert len(got) > 50 and ((got.p_quality >= 0.5) == (got.quality == 1)).mean() > 0.9
    assert got.keep[got.quality == 1].mean() > 0.95


def test_op4_rounds_equal_a_plain_version():
    """The exchange of pseudo-labels and the calibration, with lists and plain gradient steps."""
    rng = np.random.default_rng(1)
    y = rng.random(160) < 0.6
    view = lambda label, width, gap: (rng.standard_normal((len(label), width)) + gap * np.where(label, 1, -1)[:, None]).astype(np.float32)
    text, meta, hidden = view(y, 6, 0.9), view(y, 4, 0.8), rng.random(900) < 0.6
    pool = view(hidden, 6, 0.9), view(hidden, 4, 0.8)
    model = cotraining.cotrain(text, meta, y, *pool)

    by_class = [[i for i in range(160) if y[i] == c] for c in (True, False)]
    held = sorted(i for rows in by_class for i in rows[::4])
    seen = [i for i in range(160) if i not in held]
    known = [[(v[i], bool(y[i])) for i in seen] for v in (text, meta)]
    good, left = sum(bool(y[i]) for i in seen) / len(seen), set(range(900))
    for turn in range(cotraining.ROUNDS + 1):
        fitted = [plain_logistic(np.array([x for x, _ in rows]), np.array([t for _, t in rows]), penalty) for rows, penalty in zip(known, (3e-3, 1e-3), strict=True)]
        if not left or len(known[0]) > 160 + cotraining.ROUNDS * 2 * cotraining.PER_ROUND:
            break
        for mine in (0, 1):
            score = fitted[mine](pool[mine])
            p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            for label, share in ((True, good), (False, 1 - good)):
                sure = {i: p[i] if label else 1 - p[i] for i in left}
                best = sorted((i for i in left if sure[i] >= cotraining.SURE), key=lambda i: (-sure[i], i))[: max(1, round(cotraining.PER_ROUND * share))]
                left -= set(best)
                known[1 - mine] += [(pool[1 - mine][i], label) for i in best]
    for view_, mine, f in ((text, model.text, fitted[0]), (meta, model.meta, fitted[1])):
        assert np.corrcoef(mine.score(view_), f(view_))[0, 1] > 0.999
    p = model.probabilities(text[held], meta[held])
    assert all(((x >= 0.5) == y[held]).mean() > 0.9 for x in p)
    target = np.where(y[held], (y[held].sum() + 1) / (y[held].sum() + 2), 1 / ((~y[held]).sum() + 2))
    loss = lambda q: -(target * np.log(q) + (1 - target) * np.log(1 - q)).sum()
    score, fit = model.text.score(text[held]), model.text_fit
    near = [loss(1 / (1 + np.exp(-(score * (fit[0] + a) + fit[1] + b)))) for a in (-0.05, 0.05) for b in (-0.05, 0.05)]
    assert loss(1 / (1 + np.exp(-(score * fit[0] + fit[1])))) <= min(near)


def plain_logistic(x, y, penalty, steps=4000, rate=0.5):
    """Logistic regression on standardised columns by plain gradient steps, classes weighing the same."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for _ in range(steps):
        off = (1 / (1 + np.exp(-(z @ w + b))) - y) * weight
        w, b = w - rate * (z.T @ off + penalty * w), b - rate * off.sum()
    return lambda v: (v - mean) / scale @ w + b


def test_op7_spreads_over_a_whole_table(spark, data, duck):
    """Redirects between all pages whose urls differ in their last letters alone, against a union-find in Python."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    urls_ = [r["url"] for r in pages.select("url").collect()]
    ends = {}
    edges = [(u, ends.setdefault(u.rstrip("0123456789/").lower()[-5:], u)) for u in urls_]
    edges += [(f"{u}#top", f"{u}?utm_source=x") for u in urls_[::7]] + [(urls_[i], "http://gone.example.net/fr/") for i in range(0, len(urls_), 41)]
    redirects = spark.createDataFrame(edges, "src string, dst string")
    got = urls.url_verdicts(pages, queries.URL_RULES, redirects).toPandas().set_index("page_id")

    def parts(u):
        rest = re.split(r"://", u, maxsplit=1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
        query = "&".join(x for x in (m[3] or "").split("&") if x and not re.match(r"(utm_[a-z]+|gclid|fbclid|ref)=", x, re.I))
        return m[1].lower(), m[2], f"{m[1].lower()}{m[2]}{'?' + query if query else ''}"

    def rule(u):
        host, path, _ = parts(u)
        fits = [(r, a) for a, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits, key=lambda f: len(f[0]), default=(None, None))

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(parts(a)[2])] = find(parts(b)[2])
    acts = {}
    for node in list(root):
        acts.setdefault(find(node), set()).add(rule(f"x://{node}")[1])
    for r in pages.collect():
        own, node = rule(r["url"]), parts(r["url"])[2]
        spread = acts.get(find(node), set()) if node in root else set()
        want = own[1] or ("allow" if "allow" in spread else "block" if "block" in spread else "allow")
        assert (got.rule[r["page_id"]], got.verdict[r["page_id"]]) == (own[0], want)
    assert (got.verdict == "block").sum() > (queries.op7_url_filter(spark, data).toPandas().verdict == "block").sum()


def test_op5_finds_what_brute_force_finds(spark, data, docs, duck):
    items = [latent.Item(i, t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    expected = set()
    for t in docs.itertuples():
        words = latent._hash_list(t.text)
        for item in items:
            n = len(item.words)
            for a in range(0, max(1, len(words) - latent.HALF), latent.HALF):
                part = words[max(0, a - latent.MARGIN) : a + n + latent.HALF]
                if latent.confirmed(latent.lcs_length(item.masks, n, part) / n, latent.lcs_length(item.answer, item.answer_words, part) / item.answer_words):
                    expected.add((t.doc_id, item.item_id))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_benchmark_contamination(spark, data).collect()}
    assert len(got & expected) >= 0.9 * len(expected)
    texts, wanted = dict(zip(docs.doc_id, docs.text, strict=True)), dict(duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    for doc_id, item_id in got:  # each pair by the plain recurrence, over the whole text
        item = wanted[item_id].lower().split()
        row = [0] * (len(item) + 1)
        for w in texts[doc_id].lower().split():
            row = [0, *accumulate_lcs(row, item, w)]
        assert row[-1] >= latent.PARAPHRASE[0] * len(item)


def accumulate_lcs(row, item, w):
    last = 0
    for j, x in enumerate(item):
        last = row[j] + 1 if x == w else max(row[j + 1], last)
        yield last


def test_op10_places_everything_once(spark, data, docs):
    got = queries.op10_best_fit_packing(spark, data).toPandas()
    encode = tokens.encoder_of(tokens.load_vocabulary(tokens.TOKENIZER_PATH)).encode_ordinary
    need = {t.doc_id: len(encode(t.text)) + 1 for t in docs.itertuples()}
    assert got.groupby("doc_id").piece_length.sum().to_dict() == need
    for _, b in got.groupby("bin_id"):
        spans = sorted(zip(b.bin_offset, b.bin_offset + b.piece_length, strict=True))
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        used = spans[-1][1]
        assert b.bin_used.unique().tolist() == [used]
        assert b.bin_capacity.unique().tolist() == [min(c for c in packing.CAPACITIES if c >= used)]


def brute_pipeline(spark, data):
    """The stages by plain Python on their own inputs; the classifier's model is fitted once and shared."""
    from loomline.llm import cotraining

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"] for r in queries.op4_quality_cotraining(spark, data).collect() if r["keep"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    del cotraining
    words = lambda s: [w for w in re.split(r"[ \t\x0b\f\r\n]+", s.lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    near = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    seen, out = [], {}
    for i in sorted(texts):
        lines, left = texts[i].split("\n"), []
        for line in lines:
            w = words(line)
            g = grams(w)
            if not any(near(g, s) for s in seen if s & g):
                left.append(line)
            seen.append(g)
        if left:
            out[i] = "\n".join(left)
    sets = {i: grams([w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]) for i, t in out.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[:n]:
            if sets[i] & sets[j] and near(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: out[i] for i in out if find(i) == i}


def test_pipeline_equals_brute_force(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, at = docs.columns, docs
    for _, stage in p.STAGES[:3]:
        at = stage(spark, at, data)
        assert at.columns == columns
    assert {r["doc_id"]: r["text"] for r in at.collect()} == brute_pipeline(spark, data)
    clean = p.STAGES[3][1](spark, at, data)
    assert clean.columns == columns
    bad = {r["doc_id"] for r in latent.find_contamination(at, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {r["doc_id"] for r in at.collect()} - bad
    placed = p.STAGES[4][1](spark, clean, data)
    assert {r["doc_id"] for r in placed.collect()} == ids


def test_pipeline_packs_tokens(spark, data, docs):
    import corpus_pipeline as p

    encode = tokens.encoder_of(tokens.load_vocabulary(tokens.TOKENIZER_PATH)).encode_ordinary
    got = p.best_fit_packing(spark, spark.read.parquet(f"{data}/documents.parquet"), data).toPandas()
    assert got.groupby("doc_id").piece_length.sum().to_dict() == {t.doc_id: len(encode(t.text)) + 1 for t in docs.itertuples()}
    assert (got.bin_used <= got.bin_capacity).all()


def test_op1_counts_blank_documents(spark, tmp_path):
    texts = ["some words", "", " \n", None]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    n = sum(len(tokens.encoder_of(tokens.load_vocabulary(tokens.TOKENIZER_PATH)).encode_ordinary(t or "")) for t in texts)
    got = {tuple(r) for r in queries.op1_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {("a", "en", "byte_bpe_50k", 4, n, 12), ("a", "en", "words-1", 4, 2, 12)}
