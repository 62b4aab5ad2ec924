"""Training-data operators: edge cases, brute force, round trips."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from cartolith.llm import chat, common, exact, html, lines, linking, packing, quality, queries, sentencepieces, simhash, toxicity, urls

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, row long"
#: Nulls in any column, empty texts, ties, repeated rows, a long line, extra columns with clashing names.
ROWS = [
    (1, "The Same text of a few words here\nand more", 0.5, 9), (2, "the same TEXT of a few words here\nand more", None, None), (2, "the same TEXT of a few words here\nand more", 1.0, 1),
    (3, None, 0.1, 2), (4, "", 0.1, 3), (None, "text without an id but with many words in it", 0.0, 4), (5, "word " * 30000, 0.0, 5), (6, "x", 0.0, 6), (7, " \n\t", 0.0, 7),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(ROWS, DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# --- op1


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_html_takes_the_article_only(spark):
    body = (
        "<header>Top</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use</div><aside>Side</aside>"
        "<article class='post-12'><h1>A &amp; B</h1><p>One <b>two\n three<p>Four&#33;<br>five</p><form><input>Go</form><script>no()</script></article>"
        "<div id=comments><p>Nice article, I read it twice and liked it a lot more than the other one</p></div><footer>&copy;</footer>"
    )
    rows = [(k, f"http://h.example/{k}", page(body)) for k in range(5)] + [(9, None, None), (10, "http://h.example/", "")]
    found = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0].text == "A & B\nOne two three\nFour! five" and found[0].n_chars == len(found[0].text)
    assert found[9].text == "" and found[10].text == "" and len(found) == 7


def test_html_unbalanced_quotes_and_deep_tags_take_linear_time():
    texts = lambda page: [t for _, t, _ in html.blocks(page)]
    assert texts('<body><p class="x>odd words</p><p class="y">even words</p></body>') == ["odd words", "even words"]
    assert texts("<body><p>a &lt; b<!-- left open") == ["a < b"]
    began = time.monotonic()
    texts('<a href="x ' * 40_000)
    texts('<a href="x ' * 40_000 + ">")
    texts("<body><p>" + "<span>word " * 40_000)
    assert time.monotonic() - began < 10


def test_html_empty_table(spark):
    assert html.extracted(empty(spark, "page_id long, url string, html string")).collect() == []


def test_html_consensus_beats_a_page_of_its_own(spark):
    good = "<div class='story'><p>" + "words of the story " * 10 + "</p></div><div class='teaser'><p>short</p></div>"
    odd = "<div class='story'><p>tiny story</p></div><div class='teaser'><p>" + "much teaser text " * 30 + "</p></div>"
    rows = [(k, "http://a.example/", page(good)) for k in range(6)] + [(7, "http://a.example/", page(odd))]
    found = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[7] == "tiny story"


# --- op2


def test_exact_edges(spark, docs):
    path = docs.inputFiles()[0].rsplit("/", 1)[0]
    found = exact.exact_duplicates(spark, path).collect()
    groups = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found)
    assert groups[(1, 2, 3, False)] == 1 and groups[(2, 2, 3, True)] == 2
    assert groups[(3, 4, 2, False)] == 1 and groups[(4, 4, 2, True)] == 1 and len(found) == len(ROWS)


def test_exact_checks_full_texts(spark, tmp_path):
    """With a digest that collides, texts still decide."""
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "bb"), (5, "c")], "doc_id long, text string").write.parquet(path)
    from pyspark.sql import functions as F

    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(spark, path, digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 8, "0"))).collect()}
    assert found == {1: (3, 2, False), 3: (3, 2, True), 2: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_exact_state_takes_new_files_only(spark, tmp_path):
    path, state = f"file://{tmp_path}/d", f"file://{tmp_path}/s"
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)
    exact.stream_state(spark, path, state)
    spark.createDataFrame([(3, "A")], "doc_id long, text string").write.mode("append").parquet(path)
    found = sorted((r.doc_id, r.n) for r in exact.stream_state(spark, path, state).collect())
    assert found == [(2, 1), (3, 2)]


# --- op3


def test_url_rules_and_edges(spark):
    rows = [(1, "http://A.Example.NET/en/x"), (2, "http://b.net"), (3, "http://b.net/"), (4, "https://example.com/de/?q"), (5, "http://x.org/fr/1#t"), (6, None), (7, "nothing"), (8, "http://notexample.com/de/1")]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[2][2] is None and found[3][2:] == ("net/", "block") and found[4][2:] == ("example.com/de/", "block")
    assert found[5][2:] == ("org/fr/", "allow") and found[6][:2] == ("", "") and found[7][:2] == ("", "") and found[8][2] is None
    assert urls.judged(empty(spark, "page_id long, url string")).collect() == []


def test_url_template_is_rejected(spark):
    rules = (("block", "h.example", "/ads/1"), ("allow", "h.example", "/news/1"))
    rows = [(k, f"http://h.example/ads/{k}") for k in range(10, 40)] + [(100 + k, f"http://h.example/news/{k}") for k in range(10, 40)]
    found = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert found[35] == "block" and found[135] == "allow"


# --- op4


def test_quality_base_counts(spark):
    found = {r.doc_id: r for r in quality.op4_quality(spark, DATA).collect()}
    for doc, text in texts(spark).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_quality_edges(spark, docs, labels):
    found = quality.judged(docs, labels).collect()
    assert len(found) == len(ROWS) and all(r.base_failed for r in found if r.doc_id in (3, 4, 6, 7))
    assert quality.judged(empty(spark), labels).collect() == []


# --- op5


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.op5_packing(spark, DATA).collect()
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts(spark).items()}
    for r in pieces:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    at = 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * packing.SEQUENCE + r.offset == at
        at += r.length
    assert at == sum(map(len, ids.values()))
    edge = packing.packed(docs).collect()
    assert sum(r.length for r in edge if r.doc_id in (3, 4)) == 2
    assert packing.packed(empty(spark)).collect() == []


def test_packing_engines_agree():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.TextIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for text in ("don't  stop\n\n now 12 ½ x", "Ünïcödé straße", "日本語 テスト", "a b\x1cc\x85d", "<|endoftext|> is text", "   ", "🙂 ok"):
        assert own.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()


# --- op6


def test_n_best_equals_enumeration(spark, docs):
    s = sentencepieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))

    def every(word, at=0):
        if at == len(word):
            return [0.0]
        out, single = [], False
        for end in range(at + 1, min(len(word), at + s.longest) + 1):
            if word[at:end] in s.pieces:
                single |= end == at + 1
                out += [s.pieces[word[at:end]][1] + rest for rest in every(word, end)]
        return out if single else out + [s.unknown + rest for rest in every(word, at + 1)]

    for text in ("the an", "  a b", "né\nle", "x", "日本 本", "ab ab ab"):
        found = s.encode(text)
        assert [round(x, 6) for x, _ in found] == [round(x, 6) for x in sorted(every("▁" + text.replace(" ", "▁")), reverse=True)[: s.n]]
        assert all(s.decode(ids) == text for _, ids in found)
        assert len({ids for _, ids in found}) == len(found)
    edge = sentencepieces.segmented(docs).collect()
    assert Counter((r.decoded, r.nbest[0].score) for r in edge if r.doc_id in (3, 4)) == {("", 0.0): 2}
    assert Counter(r.decoded for r in edge) == Counter(x[1] or "" for x in ROWS)
    assert sentencepieces.segmented(empty(spark)).collect() == []


def test_n_best_of_ties_and_of_many_words(spark):
    s = sentencepieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("a" * 100_000, "-" * 3000, "ab" * 5000):
        found = s.encode(text)
        assert len(found) == s.n and all(s.decode(ids) == text for _, ids in found) and len({ids for _, ids in found}) == s.n
    s.encode_all(list(texts(spark).values()))
    for word, k in s.number.items():
        ids, score, loss = s.best_two(word)
        assert np.frombuffer(s.ids[k], dtype="<u2").tolist() == ids and abs(score - s.scores[k]) < 1e-9 and (loss == s.losses[k] or abs(loss - s.losses[k]) < 1e-9 or np.isnan(loss))


# --- op7


def test_golay_keys_meet_within_one_bit():
    keys, held = simhash.golay_keys()
    nearest = keys[:, 0]
    for bit in range(16):
        other = np.arange(1 << 16) ^ (1 << bit)
        assert ((keys[other] == nearest[:, None]) & (np.arange(6) < held[other][:, None])).any(axis=1).all()


def test_simhash_components(spark, docs):
    found = {r.doc_id: r for r in simhash.op7_simhash(spark, DATA).collect()}
    prints = {}
    for doc, text in texts(spark).items():
        words = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert found[doc].fingerprint == f"{prints[doc]:016x}"
    component = {d: d for d in prints}
    for _ in prints:
        before = dict(component)
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                component[a] = component[b] = min(component[a], component[b])
        if before == component:
            break
    assert {d: r.component_id for d, r in found.items()} == component
    edge = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id in (1, 2, 3, 4, 7)}
    assert edge == {(1, 1), (2, 1), (3, 3), (4, 3), (7, 3)}
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_large_buckets_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(linking, "SMALL_BUCKET", 2)
    monkeypatch.setattr(linking, "BLOCK", 16)
    base = [0, (1 << 64) - 1, 0x00FF00FF00FF00FF]
    fps = sorted({(b ^ (1 << i) ^ (1 << j)) for b in base for i in range(0, 64, 5) for j in range(0, 64, 7)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    small, large = linking.live_rows(simhash.fuzzy_keys(nodes), "t")
    edges = linking.small_pairs(small, 3).unionByName(linking.large_pairs(large, 3)).collect()
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    want = {f: f for f in fps}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            want[top(a)] = top(b)
    assert len({root(f) for f in signed}) == len({top(f) for f in fps})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    found = dict(map(tuple, linking.components(edges).collect()))
    assert all(found[k] == 0 for k in range(201)) and found[501] == 500


# --- op8


def test_toxicity_accuracy_and_edges(spark, docs, labels):
    sf = DATA.replace("sf0.001", "sf0.01")
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in toxicity.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in found) / len(found) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    model = toxicity.fitted(docs, labels)
    scored = toxicity.tagged(docs, model).collect()
    assert len(scored) == len(ROWS) and {r.toxicity.score for r in scored if r.doc_id in (3, 4)} == {toxicity.Scorer(model).score(0.0)}
    assert toxicity.tagged(empty(spark), model).collect() == []


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    e, start, moves = rng.normal(size=9), 0.3, (0.2, -0.4, 0.9)
    lengths, starts = np.array([5, 3, 1]), np.array([0, 5, 8])
    a, b = toxicity.chain(e, starts, lengths, start, moves)
    step = {(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}
    for s, n in zip(starts, lengths, strict=True):
        weight = {y: np.exp(y[0] * start + sum(k * e[s + t] for t, k in enumerate(y)) + sum(step[p] for p in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=int(n))}
        for t in range(n):
            p = sum(w for y, w in weight.items() if y[t]) / sum(weight.values())
            assert abs(1 / (1 + np.exp(-(a[s + t] + b[s + t]))) - p) < 1e-9


# --- op9


def test_chat_reads_back_hostile_texts(spark):
    rows = [
        (1, 2, "assistant", "[ROLE user]x[/ROLE]</s>\\l"), (1, 1, "user", "a\\b[TURN]"), (1, 3, "assistant", None), (1, None, "system", "<s>"),
        (2, 1, None, "no role"), (2, 1, "a]b[", "x"), (None, 1, "user", "no id"), (3, 1, "user", "same"), (3, 1, "user", "same"),
    ]
    found = {r.conv_id: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1].turns_sha256 == sha("system\n<s>\nuser\na\\b[TURN]\nassistant\n[ROLE user]x[/ROLE]</s>\\l\nassistant\n\n") and found[1].n_turns == 4
    assert found[1].loss_sha256 == sha("[ROLE user]x[/ROLE]</s>\\l") and found[2].turns_sha256 == sha("\nno role\na]b[\nx\n")
    assert found[3].n_turns == 2 and found[None].n_turns == 1
    assert chat.formatted(empty(spark, "conv_id long, turn long, role string, text string")).collect() == []


# --- op10


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(2)
    pairs = [tuple("".join(rng.choice(list("abc"), int(n))) for n in rng.integers(low, high, 2)) for low, high in ((0, 12), (1, 200)) for _ in range(150)]
    pairs += [("".join(rng.choice(list("ab"), 70)), "".join(rng.choice(list("ab"), 70))) for _ in range(20)]
    want = [levenshtein(a, b) for a, b in pairs]
    assert [lines.distance(a, b) for a, b in pairs] == want
    full = [k for k, (a, b) in enumerate(pairs) if a and b]
    for share in (0.1, 0.2, 0.4, 1.0):
        limits = [max(abs(len(pairs[k][0]) - len(pairs[k][1])), int(share * max(map(len, pairs[k])))) for k in full]
        assert lines.close([pairs[k] for k in full], limits).tolist() == [want[k] <= limit for k, limit in zip(full, limits, strict=True)]
    similar = [w <= 0.2 * max(len(a), len(b)) + 1e-9 for w, (a, b) in zip(want, pairs, strict=True)]
    assert lines.similar([a for a, _ in pairs], [b for _, b in pairs]).tolist() == similar


def similar_pairs(norms):
    """All pairs of edit similarity 0.8 or more: lengths and letter counts bound the distance from below, the rest is computed."""
    sizes = np.array(list(map(len, norms)))
    letters = sorted(set("".join(norms)))
    counts = np.array([[n.count(c) for c in letters] for n in norms], dtype=np.int32)
    found = []
    for i in range(len(norms)):
        longer, gap = np.maximum(sizes[i + 1 :], sizes[i]), np.abs(sizes[i + 1 :] - sizes[i])
        least = (np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) + gap) / 2
        found += [(i, i + 1 + int(j)) for j in np.flatnonzero(least <= 0.2 * longer + 1e-9)]
    good = lines.similar([norms[i] for i, _ in found], [norms[j] for _, j in found])
    return [p for p, g in zip(found, good, strict=True) if g]


def test_fuzzy_lines_against_brute_force(spark, monkeypatch):
    """Nothing goes that edit similarity alone would keep, and nine tenths of what it would remove go; large blocks give the same as small ones."""
    source = texts(spark)
    seen = []
    for d in sorted(source):
        own = lines.Lines([source[d]])
        seen += [(d, k, digest, own.normal(k) if own.words[k] >= lines.MIN_WORDS else None) for k, digest in enumerate(own.digests()) if digest]
    norms = sorted({n for *_, n in seen if n})
    group = list(range(len(norms)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, j in similar_pairs(norms):
        group[root(i)] = root(j)
    number = {n: k for k, n in enumerate(norms)}
    first, exact, fuzzy, repeated = {}, {}, set(), set()
    for d, k, digest, n in seen:
        if exact.setdefault(digest, (d, k)) != (d, k):
            repeated.add((d, k))
        if first.setdefault(digest if n is None else root(number[n]), (d, k)) != (d, k):
            fuzzy.add((d, k))
    results = []
    for small, hot, block in ((lines.SMALL, lines.HOT, linking.BLOCK), (1, 16, 8)):
        monkeypatch.setattr(lines, "SMALL", small)
        monkeypatch.setattr(lines, "HOT", hot)
        monkeypatch.setattr(linking, "BLOCK", block)
        rows, place = lines.located(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), "t")
        gone = lines.removals(rows, place).join(rows.select(*place, "doc_id"), place).collect()
        results.append({(r.doc_id, k) for r in gone for k in r.gone})
        assert repeated <= results[-1] <= fuzzy and len(results[-1] - repeated) >= 0.9 * len(fuzzy - repeated)
    assert results[0] == results[1]
    found = {r.doc_id: r.text for r in lines.op10_lines(spark, DATA).collect()}
    assert found == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in results[0]) for d, t in source.items()}


def test_salted_blocks_of_few_lines_are_large(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    rows = [(k % 3, 0, 40, [7]) for k in range(30)] + [(8, 0, 40, [9]), (9, 1, 40, [9])]
    frame = spark.createDataFrame(rows, "id long, fp long, chars int, blocks array<long>")
    for found in (lines.first_pairs(frame), lines.first_pairs(frame, 0, 2).unionByName(lines.first_pairs(frame, 1, 2))):
        found = found.collect()
        assert {r.a for r in found if r.b is None} == {0, 1, 2} and [(r.a, r.b) for r in found if r.b is not None] == [(8, 9)]


def test_a_text_travels_once_to_a_bucket(spark):
    texts = spark.createDataFrame([(k, str(k).encode(), f"text {k}") for k in range(200)], "id long, line binary, norm string")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 200)], "a long, b long")
    found = lines.meetings(pairs, texts).collect()
    visits = [r for r in found if r.others is not None]
    assert len(found) == 200 + len(visits) and len(visits) <= lines.BUCKETS and {r.id for r in visits} == {0}
    home = {r.id: r.bucket for r in found if r.others is None}
    assert sorted(k for r in visits for k in r.others) == list(range(1, 200)) and all(home[k] == r.bucket for r in visits for k in r.others)


def test_line_tables_go_when_they_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    frame = spark.createDataFrame([(1, "one of two lines that differ"), (2, "one of two lines that differs")], "doc_id long, text string")
    assert [r.text for r in lines.deduplicated(frame).orderBy("doc_id").collect()] == ["one of two lines that differ", ""]
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "lines-links" in left and not left & {"lines-found", "lines-texts", "lines-pairs", "lines-ids"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_normal_forms_of_lines():
    own = lines.Lines(["Ab, c_d 12!\n\n  \n--  --\nÉa e\u0301x", "日本 語\n"])
    assert [own.normal(k) for k in range(own.n)] == ["ab c d 12", "", "", "", "éa e\u0301x", "日本 語", ""]
    assert [d is None for d in own.digests()] == [False, True, True, False, False, False, True] and own.odd == {3: "-- --"}


def test_short_and_odd_lines_go_when_repeated(spark):
    rows = [(1, "--\nx\n\nno 1"), (2, "X!\n--\n\nno 2\nno 1")]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("--\nx\n\nno 1", 4, 0), 2: ("\nno 2", 5, 3)}


def test_line_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 5, 6, 7, 8), (2, "a b c d e\nother", 1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, gone int, n_removed int, __at int, line int")
    assert sorted(tuple(r)[:6] for r in lines.deduplicated(frame).collect()) == [rows[0], (2, "other", 1, 2, 3, 4)]
    assert sorted(map(tuple, lines.drop_repeated(spark, frame, DATA).collect())) == [rows[0], (2, "other", 1, 2, 3, 4)]


def test_similar_lines_go_whatever_their_simhash(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pool = [w for own in (lines.Lines([t]) for t in texts(spark).values()) for k in range(own.n) if own.words[k] >= 5 for w in own.normal(k).split(" ")]
    own = []
    for n in [5, 6, 8, 10, 12, 15, 17, 18, 20, 25, 40, 80] * 5:
        words = [str(w) for w in rng.choice(pool, n)]
        other = list(words)
        for k in rng.choice(n, max(1, n // 8), replace=False):
            other[k] = str(rng.choice(pool))
        own += [" ".join(words), " ".join(other)]
    group = list(range(len(own)))
    every = list(itertools.combinations(range(len(own)), 2))
    for (i, j), near in zip(every, lines.similar([own[i] for i, _ in every], [own[j] for _, j in every]), strict=True):
        if near:
            group = [group[i] if g == group[j] else g for g in group]
    want = {k for k, g in enumerate(group) if g not in group[:k]}
    assert len(want) < 80
    frame = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    for small in (lines.SMALL, 1):
        monkeypatch.setattr(lines, "SMALL", small)
        assert {r.doc_id for r in lines.deduplicated(frame).collect() if r.text} == want


def test_all_bits_of_fingerprints_count():
    assert list(linking.forest(np.array([0, -1, -2], dtype=np.int64), 3)) == [(1, 2)]


def test_line_edges(spark, docs):
    found = lines.deduplicated(docs).collect()
    assert len(found) == len(ROWS) and Counter(r.text for r in found if r.doc_id in (1, 2)) == {"The Same text of a few words here\nand more": 1, "": 2}
    assert [r.text for r in found if r.doc_id == 3] == [None] and [r.text for r in found if r.doc_id == 4] == [""]
    assert lines.deduplicated(empty(spark)).collect() == []


# --- all


def test_pipeline_keeps_columns_until_packing(spark):
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, frame, DATA), name)
        assert after.columns == frame.columns and 0 < after.count() <= frame.count()
        frame = after
    assert set(r[0] for r in corpus_pipeline.STAGES[-1][1](spark, frame, DATA).select("doc_id").distinct().collect()) == set(r[0] for r in frame.select("doc_id").collect())


def test_stages_on_edge_rows(spark, docs):
    """Nulls, empty texts, repeated rows and clashing names pass the filtering stages; empty tables stay empty."""
    clash = docs.selectExpr("*", "1 AS toxicity", "2 AS kept", "3 AS __row", "4 AS fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clash, DATA)
        assert found.columns == clash.columns, name
        rows = found.collect()
        assert set(rows) <= set(clash.collect()) or name == "lines", name
        assert all(r[4:] == (1, 2, 3, 4) for r in rows), name
        assert stage(spark, empty(spark), DATA).collect() == [], name


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_segmentations_of_a_word_are_searched_once(monkeypatch):
    import public_tokenizers

    own = sentencepieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4)
    calls, search = [], own.search
    monkeypatch.setattr(own, "search", lambda word, n: calls.append(word) or search(word, n))
    found = own.encode_all(["some words come again and again"] * 50)
    assert all(f == found[0] for f in found) and len(found[0]) == 4
    assert 1 <= len(calls) == len(set(calls)) <= 3


def test_toxicity_slices_are_bounded_by_bytes():
    texts = pa.array(["a" * n for n in (3, 4, 9, 1, 1, 30, 2)] + [None, "", "é" * 5])
    found = list(toxicity.slices(texts, 10))
    assert [k for at, n in found for k in range(at, at + n)] == list(range(len(texts)))
    assert found == [(0, 2), (2, 2), (4, 1), (5, 1), (6, 3), (9, 1)]
    assert list(toxicity.slices(pa.array([], pa.string()))) == []


def test_pipeline_bounds_the_batches_given_to_python(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "67108864b")
        corpus_pipeline.STAGES[0][1](spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0), "/root/testdata/sf0.001")
        assert 0 < int(spark.conf.get(name).rstrip("b")) <= 8 << 20
        spark.conf.set(name, "1000")
        common.bound_batches(spark)
        assert int(spark.conf.get(name).rstrip("b")) == 1000
    finally:
        spark.conf.set(name, before)
