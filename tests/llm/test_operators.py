"""Each operator on edge rows, on an empty table and against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import (
    chat,
    components,
    fingerprints,
    html,
    language,
    mixing,
    neardup,
    packing,
    quality,
    sharding,
    shingles,
    substrings,
)


def gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


@pytest.mark.parametrize("name", ["edge", "real"])
def test_packing_round_trip(request, name):
    docs = request.getfixturevalue(name)
    coder = packing.Encoder(packing.VOCABULARY, None, "<u4")
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, coder._bytes(coder._slow(r.text or "") + [0]))] += 1
    rows = packing.pack(docs, keep_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.start].append((r.length, bytes(r.ids), r.doc_tokens))
    sizes = [gapless(v) for _, v in sorted(sequences.items())]
    assert set(sizes[:-1]) <= {1024} and sorted(sequences) == list(range(len(sequences)))
    for (doc, ids), n in want.items():
        if n == 1:
            made = b"".join(p[0][1] for _, p in sorted(pieces[doc].items()))
            assert made == ids
    assert sum(sizes) == sum(n * len(ids) // 4 for (_, ids), n in want.items())


def test_encoder_agrees_with_tokenizer():
    fast = packing.Encoder(packing.VOCABULARY, packing.RANKS, "<u2")
    for text in ["a  b", "a   b", "\n\n x", " a", "a ", "", "a\t b\n c", " \nb", "it's 12 3.4 é", "<|endoftext|> a", "x  y"]:
        assert fast(text) == fast._bytes(fast._slow(text)), text


def repeat_words(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)})


@pytest.mark.parametrize("name", ["edge", "real"])
def test_quality_measures(request, name):
    import re

    got = quality.apply_rules(request.getfixturevalue(name), "source", ["doc_id", "text", "size_"][:2]).collect()
    assert got
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(words)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert not (r.kept and r.base_failed)


def test_quality_rejects_a_bad_host(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, f"h{i % 5}") for i in range(500)] + [(1000 + i, "short", "bad") for i in range(200)]
    rows += [(2000, good, "bad"), (2001, good, None), (2002, "short", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.apply_rules(docs).where("kept").collect()}
    assert kept == set(range(500)) | {2001}
    stage = quality.keep_good(docs)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == kept


def test_chat_edges(spark):
    talk = "</s>[INST] ok [/INST] \\l \\\\l \\ <|x|>"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, "assistant", talk)]
    rows += [(1, 3 + i, ("user", "assistant")[i % 2], f"{i} {talk} " + "word " * 60) for i in range(120)]
    rows += [(2, None, None, "x"), (None, 0, "assistant", ""), (3, 600, "assistant", "late" * 5000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, win string")
    made = chat.windows(turns)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = made.where("conv_id = 1").orderBy("window").collect()
    assert len(parts) > 3 and all(p.formatted.startswith("<|system|>be brief</s>") for p in parts)
    assert all(p.fresh_from > 0 for p in parts[1:]) and all(len(p.formatted) < 4 * 4096 for p in parts)
    assert chat.digests(chat.windows(turns.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["edge", "real"])
def test_mixing_meets_targets(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.allocate(docs, ["doc_id", "source"]).collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.allocate(docs, ["doc_id", "source"]).collect()))
    by = defaultdict(list)
    for r in rows:
        assert r.taken == r.size * r.copies <= 2 * r.size
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    for part in by.values():
        target, largest = part[0].target, max(r.size for r in part)
        assert sum(r.size for r in part) == part[0].source_size
        assert abs(sum(r.taken for r in part) - target) <= largest / 2 + 1e-6
        assert target <= 2 * part[0].source_size + 1e-6
    assert abs(sum(p[0].target for p in by.values()) - 1.5 * total) < 1e-3
    copies = mixing.mix(docs, docs.columns)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in rows)


def test_mixing_ranges_do_not_decide(edge):
    rows = [sorted(map(str, mixing.allocate(edge, chunks=n).collect())) for n in (2, 7, 4096)]
    assert rows[0] == rows[1] == rows[2]


def test_mixing_includes_by_size(spark):
    """Long documents are certain, the others enter in proportion to their words."""
    sizes = {i: 1 + i % 8 for i in range(160)} | {160: 500}
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in sizes.items()], "doc_id long, text string, source string")
    total, target, taken = sum(sizes.values()), None, Counter()
    for seed in map(str, range(6)):
        for r in mixing.allocate(docs, seed=seed).collect():
            assert r.copies in (1, 2)
            taken[sizes[r.doc_id]] += r.copies - 1
            target = r.target
    need = target - total
    rate = (need - 500) / sum(n * n for n in sizes.values() if n < 500)
    assert need > 500 and taken[500] == 6  # rate * 500 is far above 1
    for n in range(1, 9):
        p = min(1, rate * n)
        assert abs(taken[n] - 120 * p) <= 4.5 * (120 * p * (1 - p)) ** 0.5 + 2 if p < 1 else taken[n] == 120


def test_fingerprints(spark, edge, real):
    for docs in (edge, real):
        rows = fingerprints.fingerprints(docs).collect()
        texts = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())[::-1]
        want = Counter()
        for i, ((_, doc), t) in enumerate(texts):
            n, after = len(t), texts[(i + 1) % len(texts)][1]
            edited = t[: n - n // 3] + after[: n // 3]
            want[(n, hashlib.sha256(edited.encode()).hexdigest())] += 1
        assert Counter((r.n_chars, r.edited_sha256) for r in rows) == want
        assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
        known = {r.doc_id: r.text or "" for r in docs.collect()}
        prints = {(known[r.doc_id], r.fingerprint) for r in rows}
        assert len(prints) == len({t for t, _ in prints})
    near = [r.near_edited - r.near_next for r in rows]
    assert sum(x > 0 for x in near) > 0.7 * len(near)


def test_fingerprints_of_short_texts(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"t{w}" for w in rng.choice(400, rng.integers(5, 31), False)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    band = {r.term for r in fingerprints.lexicon(docs).collect()}
    df = Counter(t for x in texts for t in set(x.split()))
    assert band == {t for t, n in df.items() if 2 <= n <= 40}
    rows = fingerprints.fingerprints(docs).collect()
    kept = {r.doc_id: frozenset(band & set(texts[r.doc_id].split())) for r in rows}
    assert all(r.fingerprint[:2] != "00" for r in rows)
    assert len({r.fingerprint for r in rows}) == len(set(kept.values()))
    assert sum(r.near_edited > 0 for r in rows) > 0.8 * len(rows)


def test_fingerprint_hashes_by_brute_force(real):
    import regex
    import xxhash

    rows = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(real).collect()}
    terms = {r.doc_id: set(regex.findall(r"[\p{L}\p{N}]+", r.text.lower())) for r in real.collect()}

    def spark_hash(*parts):
        seed = 42
        for p in parts:
            raw = p.encode() if isinstance(p, str) else int(p).to_bytes(4, "little", signed=True)
            if isinstance(p, str):
                seed = xxhash.xxh64_intdigest(raw, seed)
            else:
                seed = None if seed is None else seed
        return seed

    df = Counter(t for ts in terms.values() for t in ts)
    lexicon = {r.term: list(r.subsets) for r in fingerprints.lexicon(real).collect()}
    assert all(2 <= df[t] <= 0.1 * len(terms) for t in lexicon)
    for doc, ts in terms.items():
        subsets = defaultdict(list)
        for t in ts:
            for s in lexicon.get(t, []):
                subsets[s].append(t)
        if subsets:
            want = "".join(f"{s + 1:02x}{spark_hash(*sorted(subsets[s], key=str.encode)):016x}" for s in sorted(subsets))
            assert rows[doc] == want


def test_language(spark, edge, real):
    rows = {r.doc_id: r for r in language.identify(real).collect()}
    truth = {r.doc_id: r.lang for r in real.collect()}
    held = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.9 * len(held)
    odd = {r.doc_id: r for r in language.identify(edge).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[1].score == 0
    assert language.identify(edge.limit(0)).count() == 0


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    weight = {
        p: np.exp(sum(emit[0, t, p[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        for p in product(range(3), repeat=4)
    }
    marginal, pairs = language.forward_backward(emit, move, np.ones((1, 4), bool))
    total = sum(weight.values())
    for t in range(4):
        for k in range(3):
            assert np.isclose(marginal[0, t, k], sum(w for p, w in weight.items() if p[t] == k) / total)
    want = sum(w for p, w in weight.items() if p[:2] == (0, 1)) / total
    want += sum(w for p, w in weight.items() if p[1:3] == (0, 1)) / total
    want += sum(w for p, w in weight.items() if p[2:] == (0, 1)) / total
    assert np.isclose(pairs[0, 1], want)


@pytest.mark.parametrize("name", ["edge", "real"])
def test_sharding(request, name):
    docs = request.getfixturevalue(name)
    rows = sharding.with_slots(sharding.kd_shards(docs), slot_rows=3).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if name == "real":
        size = Counter()
        for r in rows:
            size[r.shard] += r.size
        mean, largest = sum(size.values()) / 16, max(r.size for r in rows)
        assert sorted(size) == list(range(16)) and all(abs(v - mean) < largest for v in size.values())


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, y in zip(t, gone) if not y)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("name,large", [("edge", 4096), ("edge", 1), ("real", 4096), ("real", 1)])
def test_repeats(request, name, large):
    docs = request.getfixturevalue(name).limit(120)
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    got = substrings.remove_repeats(docs, large_interval=large).collect()
    want = brute_repeats([(r.text or "").encode() for r in docs.collect()], 400)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_repeats_over_chunks(monkeypatch, spark):
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(400)]
    one, two = " ".join(words), " ".join(words[100:250])
    texts = [one, "x" * 450, two + " é " + two, "y" * 399, one[50:700]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = [substrings.segments(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    assert all((p[3] <= p[4]).all() for p in parts)
    got = substrings.remove_repeats(docs).collect()
    want = brute_repeats([t.encode() for t in texts], 400)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("large", [4096, 1])
def test_repeated_words(spark, large):
    rng = np.random.default_rng(5)

    def made(n):
        return ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 9)))) for _ in range(n)]

    shared = {n: made(n) for n in (50, 51, 54, 65)}
    texts = [[*made(40), *shared[n], *made(i)] for i in (0, 3, 70) for n in shared]
    texts += [made(7) + shared[65][5:60] + shared[51], [], made(51)]
    rows = [(i, " ".join(t) if i % 2 else "\n\t".join(t) + " ") for i, t in enumerate(texts)]
    assert all(len(" ".join(t)) < 400 for t in shared.values())
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    got = substrings.remove_repeats(docs, ["doc_id"], large_interval=large, keep_text=True, words=51).collect()
    count = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    for r in got:
        t = texts[r.doc_id] if r.doc_id is not None else []
        gone = {i + k for i in range(len(t) - 50) if count[tuple(t[i : i + 51])] > 1 for k in range(51)}
        assert (r.kept_text or "").split() == [w for i, w in enumerate(t) if i not in gone]


def test_op8_tells_passages_of_over_50_words_apart(spark, tmp_path):
    def made(name, n):
        return [f"{name}{i}" for i in range(n)]

    shared = {n: made(f"{n}q", n) for n in (50, 51, 60)}
    long = made("long", 90)
    texts = [[*made(f"a{k}x{n}x", 30), *shared[n], *made(f"b{k}x{n}x", 9)] for k in range(2) for n in shared]
    texts += [[*long, *made("c", 20)], [*made("d", 20), *shared[51], *long], made("clean", 200)]
    assert all(len(" ".join(t)) < 390 for t in shared.values()) and len(" ".join(long)) > 400
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.op8(spark, str(tmp_path)).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], 400)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    count = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    assert {r.doc_id for r in got if r.n_removed} == {6, 7}
    assert {r.doc_id for r in got if r.n_cut} == {1, 2, 4, 5, 6, 7}
    for r in got:
        t = texts[r.doc_id] if r.doc_id is not None else []
        gone = {i + k for i in range(len(t) - 50) if count[tuple(t[i : i + 51])] > 1 for k in range(51)}
        assert (r.cut_text or "").split() == [w for i, w in enumerate(t) if i not in gone]
        assert r.n_cut == r.n_bytes - len((r.cut_text or "").encode()) and bool(r.n_cuts) == bool(gone)


def test_pipeline_catches_passages_of_over_50_words(spark):
    import corpus_pipeline

    rows, passages = [], [[f"{i}q{n}" for i in range(n)] for n in (51, 65)]
    for i, passage in enumerate(passages * 2):
        rows.append((i, " ".join([f"{i}a{k}own" for k in range(90)] + passage + [f"{i}b{k}own" for k in range(90)])))
    assert all(len(" ".join(p)) < 400 for p in passages)
    got = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(got) == 4 and all("q" not in r.text and r.text.count("own") == 180 for r in got)


def test_html():
    page = (
        "<html><head><title>T</title></head><body><nav><a>home</a></nav><div class='ad x'>buy</div><article>"
        "<h1>Head &amp; tail</h1><p>one <b>two</b>\n three<br>four<aside>side</aside><script>var x='</p>';</script>"
        "<p>five &lt;six&gt;</article><footer>&copy; me</footer></body>"
    )
    assert [t for z, t in html.blocks(page) if z == "main"] == ["Head & tail", "one two three", "four", "five <six>"]


def test_html_hosts(spark):
    menu = "<div>Home About Contact Imprint Login Help</div>"
    rows = [(i, f"http://h/{i}", f"{menu}<div>page number {i} has its own text {i} here</div>") for i in range(4)]
    rows += [(9, "http://other/", f"{menu}<p>alone</p>"), (10, None, None), (11, "x", "")]
    rows += [(12, "http://h/12", "<article><p>page number 1 has its own text</p></article>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "page number 2 has its own text 2 here" and got[12] == "page number 1 has its own text"
    assert got[9] == "Home About Contact Imprint Login Help\nalone" and got[10] == got[11] == ""


def test_html_prose_without_article_on_a_large_host(spark):
    rng = np.random.default_rng(11)
    phrases = [" ".join(f"v{w}" for w in rng.integers(0, 300, 6)) for _ in range(200)]
    quote = " ".join(f"quoted{i}" for i in range(30))
    menu, legal = "Home About Contact", " ".join(f"legal{i}" for i in range(40))
    prose = [" ".join(phrases[k] for k in rng.integers(0, 200, 12)) for _ in range(3000)]
    prose = [f"{p} {quote}" if i < 50 else p for i, p in enumerate(prose)]
    want = {i: f"Notes\n{p}" if i < 50 else p for i, p in enumerate(prose)}
    rows = [
        (i, "http://h/", f"<div>{menu}</div>{'<h2>Notes</h2>' if i < 50 else ''}<p>{p}</p><div>{legal} {i}</div>")
        for i, p in enumerate(prose)
    ]
    rows += [(10_000 + i, u, h) for i, u, h in rows[:500] for _ in range(2)]  # copies
    rows += [(20_000 + i, "http://copies/", "<p>the same page under many names</p>") for i in range(50)]
    rows += [(30_000 + i, "http://small/", f"<p>{quote}</p><p>page {i}</p>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 20_000:
            i = r.page_id % 10_000
            assert r.text == f"{want[i]}\n{i}"
        elif r.page_id < 30_000:
            assert r.text == "the same page under many names"
        else:
            assert r.text == f"{quote}\npage {r.page_id - 30_000}"


def test_html_frames_inside_articles(spark):
    """Blocks that most articles of a host have go; text that some share, and copies, stay."""
    def page(i, host, blocks):
        return i, f"http://{host}/{i}", "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"

    def own(i):
        return [f"page {i} tells " + " ".join(f"w{i}x{k}" for k in range(12)), f"and it ends {i} as it does"]

    notice = "Sign up here for our weekly letter"
    rows = [page(i, "frame", [notice, *own(i), "Read more"][: 4 if i % 2 else 3]) for i in range(24)]
    rows += [page(100 + i, "few", [*own(i), notice][: 3 if i < 9 else 2]) for i in range(24)]
    rows += [page(200 + i, "near", [*own(0), f"copy {i}"]) for i in range(24)]
    rows += [page(300 + i, "same", [*own(0), notice]) for i in range(24)]
    rows += [page(400 + i, "small", [*own(i), notice]) for i in range(9)]
    want = {i: own(i) for i in range(24)}
    want |= {100 + i: [*own(i), notice][: 3 if i < 9 else 2] for i in range(24)}
    want |= {200 + i: [*own(0), f"copy {i}"] for i in range(24)} | {300 + i: [*own(0), notice] for i in range(24)}
    want |= {400 + i: [*own(i), notice] for i in range(9)}
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: "\n".join(b) for i, b in want.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def brute_components(docs, words):
    sets = {}
    for r in docs.collect():
        if r.doc_id is not None:
            ws = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
            for c in "\t\n\x0b\x0c\r":
                ws = ws.replace(c, " ")
            ws = [w for w in ws.split(" ") if w]
            n = min(words, len(ws))
            sets[r.doc_id] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def sizes_of(shape, n):
    rng = np.random.default_rng(n)
    if shape == "equal":
        return [40] * n
    if shape == "one huge":
        return [100_000] + [30] * (n - 1)
    return (20 * (1 + rng.pareto(1.1, n))).astype(int).tolist()


@pytest.mark.parametrize(
    "shape, n",
    [("equal", 2), ("equal", 15), ("equal", 20), ("one huge", 17), ("heavy tail", 21), ("heavy tail", 300)],
)
def test_shards_stay_in_range(spark, shape, n):
    rows = [(i, (f"{i} " * size)[:size]) for i, size in enumerate(sizes_of(shape, n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.kd_shards(docs, dimensions={"size": F.octet_length("text").cast("double")}).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert len(got) == n and set(loads) <= set(range(16))
    if shape == "equal":
        assert len(loads) == min(n, 16) and max(loads.values()) <= 2 * 41 * -(-n // 16)
    if shape == "heavy tail" and n == 300:
        assert len(loads) >= 14 and max(loads.values()) < 1.6 * max(sum(loads.values()) / 16, max(r.size for r in got))


def test_shards_for_a_target(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "repeat('x', 99) || id AS text", "'en' AS lang")
    got = Counter(r.shard for r in sharding.kd_shards(docs, target_bytes=9_000.0).collect())
    assert set(got) == set(range(11)) and max(got.values()) < 1.3 * min(got.values())
    ties = spark.range(200).selectExpr("1L AS doc_id", "'same' AS text", "'en' AS lang")
    assert {r.shard for r in sharding.kd_shards(ties).collect()} == {0}


@pytest.mark.parametrize("k", [16, 128])
def test_links_for_any_sketch_size(spark, k):
    rows = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:150] + ["new"] + words[151:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k=k).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


@pytest.mark.parametrize("name", ["edge", "real"])
def test_near_duplicates(request, name):
    docs = request.getfixturevalue(name)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    for doc, (n, root) in brute_components(docs, 4).items():
        assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (n, root, doc == root)
    kept = neardup.deduplicate(docs, words=4)
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert set(ids) == {d for d, r in got.items() if d is not None and r.kept}


def test_near_duplicates_in_long_lists(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 7))):
            words[j] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {d: root for d, (_, root) in brute_components(docs, 4).items()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_shingles_of_short_texts():
    assert len(shingles.shingle_set("", 4)) == 0 and len(shingles.shingle_set("One two", 4)) == 1
    assert (shingles.shingle_set("One\ttwo", 4) == shingles.shingle_set("one two", 4)).all()


def test_empty_tables(empty):
    assert packing.pack(empty).count() == 0
    assert quality.apply_rules(empty).count() == 0
    assert mixing.allocate(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert sharding.with_slots(sharding.kd_shards(empty)).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    pages = empty.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert html.extract(pages).count() == 0


def test_pipeline(spark, real):
    import corpus_pipeline

    docs = real
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        docs = after
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.sum("length")).first()[0] > 0
