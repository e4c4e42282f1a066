"""Decontamination, page text, token files, language model, toxicity and mixing."""

import hashlib
import math
import json
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus
from meshledger.llm import brown_lm, decontaminate, html_text, mixing, repair, token_files, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontaminate(spark):
    found = corpus.rows()
    source = [words_of(t) for _, t in found]
    items = [(1, " ".join(source[20][:14])), (2, "water been call"), (2, " ".join(source[30][-12:])), (10, "No such Words here " * 4),
             (None, " ".join(source[40][:11])), (3, None), (4, " . "), (5, source[25][0] if source[25] else "oil"), (6, " ".join(source[20][:10]))]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    want = []
    for (i, _), own in zip(found, source):
        hit, ids = set(), set()
        for item, text in items:
            w = words_of(text)
            size = min(10, len(w))
            for a in range(len(w) - size + 1 if size else 0):
                for j in range(len(own) - size + 1):
                    if own[j:j + size] == w[a:a + size]:
                        hit |= set(range(j, j + size))
                        ids |= {str(item)} if item is not None else set()
        want.append((i, len(own), len(hit), tuple(sorted(ids))))
    got = decontaminate.decontaminate(corpus.frame(spark, found), bench).collect()
    assert corpus.ordered((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == corpus.ordered(want)
    empty = decontaminate.decontaminate(corpus.frame(spark, found), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert empty == 0 and decontaminate.decontaminate(corpus.frame(spark, []), bench).count() == 0


def test_winnowing_keeps_a_hash_of_every_shared_span():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 1 << 62, 10, dtype=np.uint64)
        found = []
        for _ in range(2):
            text = np.concatenate([rng.integers(0, 1 << 62, rng.integers(0, 30), dtype=np.uint64), shared,
                                   rng.integers(0, 1 << 62, rng.integers(0, 30), dtype=np.uint64)])
            runs = decontaminate._runs(text, np.array([0, len(text)]), 5, 2)
            found.append(set(runs[decontaminate._winnow(runs, np.array([0, len(text)]))].tolist()))
        assert found[0] & found[1]


PAGES = {
    "": "", "<p>": "", "plain &amp; simple": "plain & simple", "<p>one<p>two": "one\ntwo",
    "<article><header><h1>Title</h1></header><p>Some text that is long enough to count.</p><p>No.</p></article><footer>bye</footer>":
        "Title\nSome text that is long enough to count.\nNo.",
    "<header>Site</header><nav><a href=x>Home</a></nav><main><p>Body  of\nthe <b>page</b>&nbsp;here.<script>var a='<p>x</p>'</script></p>"
    "<aside>more</aside><form><input><button>Send</button></form><ul><li>a<li>b</ul><div class='comments'><p>I agree very much with this.</p></div></main>":
        "Body of the page here.\na\nb",
    "<div class=cookie-notice>We use cookies</div><div id=menu><a>A</a><a>B</a></div><div><h2>Head</h2><p>" + "word " * 40 + "</p><p>mid.</p><p>"
    + "more " * 40 + "</p></div><div class='sidebar'><p>" + "side " * 30 + "</p></div>": "Head\n" + ("word " * 40).strip() + "\nmid.\n" + ("more " * 40).strip(),
    "<article><p>text &lt;b&gt; &#x41;&#66;<br>next<!-- no --></article>": "text <b> AB next",
}


def test_main_text(spark):
    found = [(k, f"u{k}", html) for k, html in enumerate([*PAGES, None, "<p>one<p>two"])]
    pages = spark.createDataFrame([(*r, "x") for r in found], "page_id long, url string, html string, text string").repartition(2)
    got = {r.page_id: (r.url, r.text) for r in html_text.extract_text(pages).collect()}
    assert got == {k: (u, PAGES.get(h, "")) for k, u, h in found}
    assert html_text.extract_text(pages.limit(0)).count() == 0


PROSE = "A sentence of the article that is long enough to count as content. " * 4
TITLED = f"<h1>Title</h1><p>{PROSE}</p><p>Short end.</p>"
TITLED_TEXT = f"Title\n{PROSE.strip()}\nShort end."


@pytest.mark.parametrize("wrapper", [
    "div class='container has-sidebar'", "div class='no-sidebar'", "div class='layout-top-nav'", "div class='sidebar'", "div class='page menu'",
    "div id=comments", "div class='modal' role=dialog", "form id=aspnetForm action=x", "div hidden", "div class=banner", "aside", "div class='site-header'"])
def test_wrappers_of_an_article_do_not_hide_it(wrapper):
    tag = wrapper.split()[0]
    assert html_text.main_text(f"<body><{wrapper}><nav><a href=x>Home</a></nav><article>{TITLED}</article></{tag}></body>") == TITLED_TEXT
    assert html_text.main_text(f"<{wrapper}><div><main>{TITLED}<div class=ad>Buy this</div></main></div></{tag}><footer>bye</footer>") == TITLED_TEXT


@pytest.mark.parametrize("inner", [
    "section id='related-work'", "section id='social-impact'", "div class='notice-period'", "div class='page-header'", "section class='share-of-votes'",
    "span class='menu-engineering'"])
def test_names_that_only_hold_a_listed_word_are_content(inner):
    tag = inner.split()[0]
    page = f"<article><h1 class='page-header'>Title</h1><p>{PROSE}</p><{inner}>More of it.</{tag}><p>End.</p></article>"
    assert html_text.main_text(page) == f"Title\n{PROSE.strip()}\nMore of it.\nEnd."


def test_page_wide_forms_and_marked_elements_with_most_of_the_text():
    aside = f"<div class='sidebar'><a href=x>Other</a></div><p>{PROSE}</p>"
    assert html_text.main_text(f"<form method=post><input type=hidden><div><h2>Head</h2><p>{PROSE}</p>{aside}</div></form>") == "\n".join(
        ["Head", PROSE.strip(), PROSE.strip()])
    assert html_text.main_text(f"<article><h1>Title</h1><section id='related'><p>{PROSE}</p></section></article>") == f"Title\n{PROSE.strip()}"
    # neither pushes out what stands beside it
    assert html_text.main_text(f"<div id=post><p>{PROSE}</p></div><div class=widget><p>{PROSE * 3}</p></div>").startswith(PROSE.strip() + "\n")
    assert html_text.main_text(f"<div id=post><p>{PROSE}</p></div><div class=comments><p>{PROSE * 3}</p></div>") == PROSE.strip()
    assert html_text.main_text(f"<main><p>{PROSE}</p></main><aside><p>{PROSE * 3}</p></aside>") == PROSE.strip()
    assert html_text.main_text(f"<div class='menu'><h2>Head</h2><p>{PROSE}</p></div>") == f"Head\n{PROSE.strip()}"
    teasers = "<article><p>Another story.</p></article>" * 3
    assert html_text.main_text(f"<main><article>{TITLED}</article><div class='related-posts'>{teasers}</div></main>") == TITLED_TEXT
    assert html_text.main_text(f"<p>before <span class=ad>Buy</span> after {PROSE}</p>") == f"before\nafter {PROSE.strip()}"


def test_left_out_end_tags_and_several_articles():
    text = PROSE.strip()
    assert html_text.main_text(f"<head><title>T</title><meta charset=u><body><article><p>{PROSE}</article>") == text
    assert html_text.main_text(f"<head><title>T</title><article><p>{PROSE}</article>") == text
    assert html_text.main_text(f"<body><article><p>{PROSE}</p><select><option>a<option>b<p>{PROSE}</p></article>") == f"{text}\n{text}"
    two = f"<article><p>one {PROSE}</p></article><article><p>two {PROSE}</p></article>"
    assert html_text.main_text(f"<body>{two}</body>") == f"one {text}\ntwo {text}"
    assert html_text.main_text(f"<body><main>{two}</main></body>") == f"one {text}\ntwo {text}"
    comment = f"<article class='comment-body'><p>I say {PROSE}</p></article>"
    assert html_text.main_text(f"<article><p>{PROSE}</p><p>{PROSE}</p>{comment}</article>") == f"{text}\n{text}"
    assert html_text.main_text(f"<article><p>{PROSE}</p></article><article><p>Short teaser.</p></article>") == text


def test_very_long_and_broken_pages():
    assert html_text.main_text("<div>" * 3000 + "deep text") == "deep text"
    assert len(html_text.main_text("<article>" + "<p>" + "long words " * 200_000)) == len("long words " * 200_000) - 1
    html_text.main_text("<" * 2000 + "<a <b <!-- <![CDATA[ </ x> &#xFFFFFFF; &bogus;")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=40), max_size=6), st.sampled_from([7, 65530, 70000]))
def test_repair_round_trip(docs, base):
    docs = [d * 6 for d in docs]
    first = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
    shard = repair.Shard.read(repair.encode(np.array([i for d in docs for i in d], np.uint32), first, base, 2))
    flat, begin = shard.documents()
    for k, d in enumerate(docs):
        assert flat[begin[k]:begin[k + 1]].tolist() == shard.document(k).tolist() == d + [2]
        for a, b in ((0, 3), (2, 2), (5, 17), (len(d) - 1, len(d) + 1), (len(d), len(d) + 1), (0, 10 ** 6), (len(d) + 1, len(d) + 5)):
            a = max(a, 0)
            assert shard.slice(k, a, b).tolist() == (d + [2])[a:b]
    assert all(n == len(shard.expand(np.array([base + k]))) for k, n in enumerate(shard.lengths[base:]))


def test_repair_shrinks_repeats():
    ids = np.tile(np.arange(50), 400)
    assert len(repair.encode(ids, np.array([0, len(ids)]), 49408, 2)) < len(ids)


def test_repair_runs_to_its_end():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 49_000, 500)
    shard = repair.Shard.read(repair.encode(np.tile(passage, 7), np.array([0, 3500]), 49408, 2))
    assert shard.lengths.max() >= 500 and len(shard.symbols) <= 7
    # random repeats over more rules than 16 bits have room for: no pair is left that would pay
    words = [rng.integers(0, 49_000, 3) for _ in range(20_000)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 20_000, 150_000)])
    rules, seq, first = repair.grammar(ids, np.array([0, len(ids)]), 49408)
    assert 49408 + len(rules) > 1 << 16
    pairs, counts = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)
    assert counts[pairs[0] != pairs[1]].max() < repair.LEAST
    read = repair.Shard.read(repair.encode(ids, np.array([0, len(ids)]), 49408, 2))
    assert (read.documents()[0][:-1] == ids).all()


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_packed_symbols(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 70_001):
        symbols = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = np.frombuffer(repair.pack(symbols, bits), np.uint8)
        assert len(data) == (n * bits + 7) // 8 and (repair.unpack(data, n, bits) == symbols).all()


def test_ids_of_words_are_those_of_the_text():
    from pathlib import Path

    import public_tokenizers
    from tokenizers import Tokenizer

    marks = [c + m + rest for c in "JHTWYAEZ" for m in "\u030c\u0331\u0308\u030a\u0301\u0327" for rest in ("", " a", "B c")]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        definition = Path(public_tokenizers.path(name)).read_text()
        assert token_files.goes_by_words(definition) == by_words
        tokenizer, encoder = Tokenizer.from_str(definition), token_files.WordIds(definition)
        texts = [*marks, *(t or "" for _, t in corpus.rows()), "\u0130stanbul \u212aELVIN \u00c5 A\u030a <|endoftext|>A\u0301"]
        flat, first = encoder.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert flat[first[k]:first[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    other = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    other["normalizer"]["normalizers"].append({"type": "StripAccents"})
    assert not token_files.goes_by_words(json.dumps(other))


def _word_ids():
    from pathlib import Path

    from tokenizers import Tokenizer

    definition = Path(token_files.default_tokenizer()).read_text()
    return token_files.WordIds(definition), Tokenizer.from_str(definition)


def test_words_are_learned_once_whatever_marks_they_carry():
    encoder, _ = _word_ids()
    encoder.encode([b'Alpha alpha### (alpha) "ALPHA" alpha, alpha; ***alpha*** alpha.', b"it's alpha..."])
    assert set(encoder.known) == {b"alpha", b"###", b"(", b")", b'"', b",", b";", b"***", b".", b"it", b"'s", b"..."}


@pytest.mark.parametrize("slot_bits", [2, 21])
def test_ids_of_words_next_to_marks(slot_bits, monkeypatch):
    """Also with few slots, so that most words lose theirs, and a table that is full at every text."""
    monkeypatch.setattr(token_files, "SLOT_BITS", slot_bits)
    rng = random.Random(slot_bits)
    parts = ["a", "Word", "\u00e9t\u00e9", "\u00c9", "F\u00fc", "'", "'s", "'LL", "s", "re", "7", "42", ".", "...", ",", "<", "|", "=", "\u0338", "A\u030a", "\u0301", "\u05b0",
             "\u00f7", "\u212a", "\u037e", "\u1fef", "\u00a0", "\x85", "\x00", "\x1c", "\x7f", " ", "  ", "\n", "\u4e00", "\u00aa", "\u01c5", "\u03a3", "\U0001f600",
             "averyveryverylongwordindeed", "sixteenletters16", "fifteenletters!", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "@"]
    texts = ["", " ", "'", "don't 'tis dogs'rest it'S ''s .'s 'sx,", *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000))]
    for known_words in (400_000, 20):
        monkeypatch.setattr(token_files, "KNOWN_WORDS", known_words)
        encoder, tokenizer = _word_ids()
        texts.append(encoder.between.decode() + "! \u4e00" + encoder.between.decode())  # the word that stands between others comes itself
        for a in range(0, len(texts), 500):
            for _ in range(2):
                flat, first = encoder.encode([t.encode() for t in texts[a:a + 500]])
                for k, t in enumerate(texts[a:a + 500]):
                    assert flat[first[k]:first[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_keys_tell_words_apart():
    words = [b"a", b"a\0", b"\0a", b"\0", b"\0\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"x" * 14, b"x" * 15, b"y" * 15, b"\xff" * 15]
    longer = [b"x" * 16, b"x" * 40, b"\xff" * 16]
    ends = np.cumsum([len(w) for w in words + longer])
    data = np.frombuffer(b"".join(words + longer), np.uint8)
    low, high = token_files._keys(data, np.r_[0, ends[:-1]], ends)
    keys = list(zip(low.tolist(), high.tolist()))
    assert len(set(keys[:len(words)])) == len(words)
    assert all(h == (1 << 64) - 1 for h in high[len(words):].tolist()) and all(h >> 56 <= 15 for h in high[:len(words)].tolist())


def test_repair_leaves_no_pair_that_pays():
    """Uses that lost to an overlapping pair, or came up again later, are replaced as well; also in runs of one symbol."""
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 3, 8, 60):
        for _ in range(8):
            sizes = rng.integers(0, 400, 9)
            ids, first = rng.integers(0, alphabet, sizes.sum()), np.r_[0, np.cumsum(sizes)]
            rules, seq, start = repair.grammar(ids, first, alphabet)
            pairs = Counter(p for a, b in zip(start[:-1].tolist(), start[1:].tolist()) for p in zip(seq[a:b].tolist(), seq[a + 1:b].tolist()) if p[0] != p[1])
            assert max(pairs.values(), default=0) < repair.LEAST
            flat, at = repair.Shard.read(repair.encode(ids, first, alphabet, alphabet + 1)).documents()
            assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[*ids[a:b].tolist(), alphabet + 1] for a, b in zip(first[:-1], first[1:])]


def test_token_files(spark, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    found = corpus.rows() + [(700, "a<|endoftext|>B <|ENDOFTEXT|> x"), (701, "It's a.b c.. d., E. Ångstŕom ǅ \x85 Σας ΣΑΣ. 3.14 z,")]
    path = str(tmp_path / "ids")
    token_files.write_token_files(corpus.frame(spark, found), path, token_files.default_tokenizer())
    got = token_files.read_token_files(spark, path).collect()
    want = []
    for i, t in found:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert corpus.ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == corpus.ordered(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [corpus.rank(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    empty = str(tmp_path / "none")
    token_files.write_token_files(corpus.frame(spark, []), empty, token_files.default_tokenizer())
    assert token_files.read_token_files(spark, empty).count() == 0


def test_language_model_base(spark):
    found = corpus.rows()
    train, split = Counter(), []
    for i, t in found:
        w = [*(t or "").encode().lower().split(), b" "]
        split.append(w)
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(w)
    n, v = sum(train.values()), len(train)
    got = {}
    for r in brown_lm.brown_lm(corpus.frame(spark, found)).collect():
        got.setdefault(r.id, []).append(r)
    for (i, _), w in zip(found, split):
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
        assert any((r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
                   and math.isclose(r.base_score, base, rel_tol=1e-9) and r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
                   and math.isfinite(r.score) for r in got[i]), i
    assert sum(map(len, got.values())) == len(found)
    assert brown_lm.brown_lm(corpus.frame(spark, [])).count() == 0


def test_language_model_learns_order(spark):
    """Texts of two languages that never mix: classes must tell them apart, so held-out texts get likelier than by counts alone."""
    rng = random.Random(2)
    one, two = ([f"{p}{k}" for k in range(40)] for p in "ab")
    found = [(k, " ".join(rng.choice(one if k % 2 else two) for _ in range(60))) for k in range(300)]
    got = brown_lm.brown_lm(corpus.frame(spark, found)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.9


def test_class_model_is_a_distribution(spark):
    found = corpus.rows()
    train = spark.createDataFrame([(k, k, t or "", True) for k, (_, t) in enumerate(found)], "rank long, key long, text string, train boolean")
    model, counts, _ = brown_lm.fit(train)
    assert np.allclose((10 ** model.log_move).sum(axis=1), 1)
    words = counts.collect()
    _, unit = model.units_of([bytes(r.word) for r in words])
    mass = np.bincount(model.of_unit[unit], [r.n + 1 for r in words], brown_lm.CLASSES) / 10 ** model.log_total
    assert (mass <= 1 + 1e-9).all()


@pytest.mark.parametrize("share", [1e-6, 0.5 / 60])
def test_pooled_words_get_the_class_of_their_neighbours(spark, monkeypatch, share):
    """Words too rare for units, listed or not, stand where one of two units stands: they get the class of that unit."""
    monkeypatch.setattr(brown_lm, "UNIT_SHARE", 3 / 60)
    monkeypatch.setattr(brown_lm, "KNOWN_SHARE", share)
    rng = random.Random(4)
    rare = {k: [f"{k}{x}same" for x in range(30)] for k in "pq"}
    sides = {"p": ("left", "mid"), "q": ("west", "far")}
    texts = []
    for _ in range(120):
        kinds = [rng.choice("pq") for _ in range(20)]
        texts.append(" ".join(f"{sides[k][0]} {rng.choice([f'{k}unit', rng.choice(rare[k])])} {sides[k][1]}" for k in kinds))
    train = spark.createDataFrame([(k, k, t, True) for k, t in enumerate(texts)], "rank long, key long, text string, train boolean")
    model, words, strings = brown_lm.fit(train)
    found = {bytes(r.word).decode(): r for r in words.collect()}
    cls = {w: r.cls for w, r in found.items()}
    unit = lambda w: int(model.of_unit[model.units_of([w])[1][0]])
    often = {k: [w for w in rare[k] if found[w].n >= brown_lm.EVIDENCE] for k in "pq"}
    assert all(len(often[k]) > 20 and {cls[w] for w in often[k]} == {unit(f"{k}unit".encode())} for k in "pq")
    assert unit(b"punit") != unit(b"qunit")
    # pairs of classes are counted with these classes, and scores use them
    of = lambda w: cls[w.decode()] if cls.get(w.decode()) is not None else unit(w)
    table, count = np.zeros((brown_lm.CLASSES,) * 2), Counter()
    split = [[*t.encode().split(), b" "] for t in texts]
    for w in split:
        count.update(w)
        for a, b in zip([b" ", *w], w):
            table[of(a), of(b)] += 1
    tokens = np.bincount([of(w) for w in count], list(count.values()), brown_lm.CLASSES)
    move = (table + brown_lm.BACKOFF * (tokens + 1) / (tokens.sum() + brown_lm.CLASSES)) / (table.sum(axis=1, keepdims=True) + brown_lm.BACKOFF)
    assert np.allclose(10 ** model.log_move, move)
    got = {r["rank"]: r for r in brown_lm.scores(strings, model).collect()}
    for k, w in enumerate(split):
        want = sum(math.log10(move[of(a), of(b)]) - model.log_total[of(b)] for a, b in zip([b" ", *w], w))
        assert math.isclose(got[k].log_model, want, rel_tol=1e-9) and got[k].n_known == got[k].n_tokens == len(w)


def test_language_model_of_one_text_and_of_repeated_rows(spark):
    """One short text has too few tokens to list any; repeated rows count as often as they come."""
    one = brown_lm.brown_lm(corpus.frame(spark, [(2, "a b")])).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (3, 3, 3) and math.isfinite(one.score)
    many = brown_lm.brown_lm(corpus.frame(spark, [(2, "a b"), (2, "a b"), (2, "a b"), (3, "b c")])).collect()
    assert len(many) == 4 and {r.train_tokens for r in many} == {12}
    assert len({(r.n_known, round(r.score, 9)) for r in many if r.id == 2}) == 1


def test_best_class_equals_the_objective():
    rng = np.random.default_rng(5)
    units, classes = 9, 4
    pairs = rng.integers(0, 6, (units, units)).astype(float)
    of = rng.integers(0, classes, units)

    def objective(of):
        t = np.zeros((classes, classes))
        np.add.at(t, (of[:, None], of[None, :]), pairs)
        f = brown_lm._entropy_term
        return f(t).sum() - f(t.sum(axis=1)).sum() - f(t.sum(axis=0)).sum()

    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    for u in range(units):
        right, left = np.bincount(of, pairs[u], classes), np.bincount(of, pairs[:, u], classes)
        tries = []
        for c in range(classes):
            to = of.copy()
            to[u] = c
            tries.append(objective(to))
        best = brown_lm.best_class(table, right, left, pairs[u, u], int(of[u]))
        assert math.isclose(tries[best], max(tries), abs_tol=1e-6)
        brown_lm.move(table, right.astype(float), left.astype(float), pairs[u, u], int(of[u]), best)
        of[u] = best
        want = np.zeros((classes, classes))
        np.add.at(want, (of[:, None], of[None, :]), pairs)
        assert np.allclose(table, want)


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    found, marks = [], []
    for k in range(1500):
        w = [rng.choice(corpus.WORDS) for _ in range(40)]
        if k % 6 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(("nasty", "vile", "rotten", "Foul,"))
        found.append((k, " ".join(w)))
        marks.append((k, int(k % 6 == 0)))
    marks += [(None, 1), (5000, 1), (3, None), (6, 1), (6, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = corpus.frame(spark, found + [(2000, None), (2001, ""), (None, "nasty vile"), (None, None), (2002, "x " * 50_000)])
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 1505 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [(r.predicted, r.id % 6 == 0) for r in got if r.held_out and r.id is not None and r.id < 1500]
    assert sum(p == t for p, t in test) > 0.97 * len(test)
    assert all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.5, 0.5)
    assert toxicity.toxicity(corpus.frame(spark, []), labels).count() == 0


def test_coordinates_are_averaged_over_the_shards_that_met_them(spark):
    """Shards without a word in common: after a round each word has the weight its own shard gives it."""
    kind = "order long, text string, label int"
    rows = [(k, f"word{k % 4} {'mean' if k % 8 < 4 else 'kind'}{k % 4}", int(k % 8 < 4)) for k in range(400)]
    at, w = toxicity.train(spark.createDataFrame(rows, kind), rounds=1, shards=4)
    got = dict(zip(at.tolist(), w.tolist()))
    want = {}
    for shard in range(4):
        at, w = toxicity.train(spark.createDataFrame([r for r in rows if r[0] % 4 == shard], kind), rounds=1)
        want |= dict(zip(at.tolist(), w.tolist()))
    got.pop(0, None), want.pop(0, None)
    assert len(want) >= 8 and got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_toxicity_learns_from_a_bounded_sample(spark):
    docs = corpus.frame(spark, [(k, f"w{k} nasty" if k % 2 else f"w{k} nice") for k in range(300)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels, max_rows=20).count() == 300


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(9)
    found = [(k, " ".join(rng.choice(("alpha beta gamma" if k % 3 else "delta beta omega").split()) for _ in range(rng.randint(1, 80)))) for k in range(400)]
    found += [(900, None), (901, ""), (None, "alpha alpha"), found[5], found[5]]
    labels = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(0, 400, 2)] + [(None, "a"), (4, None), (6, "other")], "id long, domain string")
    got = mixing.mix(corpus.frame(spark, found), labels, {"a": 0.5, "b": 0.5}, budget=1.0).collect()
    assert len(got) == len(found) and all(r.rate >= 0 for r in got)
    n, p, rate = np.array([r.n_tokens for r in got]), np.array([(r.p_a, r.p_b) for r in got]), np.array([r.rate for r in got])
    assert np.allclose(p.sum(axis=1), 1)
    assert np.allclose((rate * n) @ p, [n.sum() / 2, n.sum() / 2], rtol=1e-6)
    assert all(r.n_tokens == len((dict(found)[r.id] or "").split()) for r in got if r.id is not None)
    assert [r.rate for r in got if r.n_tokens == 0] == [1.0, 1.0]


def test_mixing_equals_projected_gradient(spark):
    rng = np.random.default_rng(3)
    n, p = rng.integers(0, 50, 60), rng.dirichlet((0.3, 0.3, 0.3), 60)
    found = spark.createDataFrame([(int(a), 1, *map(float, b)) for a, b in zip(n, p)], "n_tokens long, copies long, p0 double, p1 double, p2 double")
    want = np.array([n.sum() * 0.9, n.sum() * 0.05, n.sum() * 0.05])
    x, r = n[:, None] * p, np.ones(60)
    for _ in range(mixing.STEPS):
        free = x[r > 0]
        r = np.maximum(0, r + x @ (np.linalg.pinv(free.T @ free, rcond=1e-10) @ (want - x.T @ r)))
    rate, residual = mixing.fit_rates(found, want.tolist())
    got = np.array([g.r for g in found.select(rate.alias("r")).collect()])
    assert residual <= mixing.TOLERANCE and np.allclose(sorted(got), sorted(r), atol=1e-6)


def test_mixing_says_when_targets_cannot_be_met(spark):
    found = spark.createDataFrame([(10, 1, 1.0, 0.0), (20, 3, 1.0, 0.0)], "n_tokens long, copies long, p0 double, p1 double")
    assert abs(mixing.fit_rates(found, [50.0, 100.0])[1] - 1.0) < 1e-9
    assert mixing.fit_rates(found, [50.0, 0.0])[1] <= mixing.TOLERANCE


def test_mixing_targets_of_the_test_table(spark):
    got = mixing.op2_mixing(spark, "/root/testdata/sf0.01").toPandas()
    domains = sorted(mixing.TARGETS)
    totals = [(got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in domains]
    want = [mixing.BUDGET * got["n_tokens"].sum() * mixing.TARGETS[d] for d in domains]
    assert np.allclose(totals, want, rtol=1e-6) and got["residual"].max() <= mixing.TOLERANCE


def test_mixing_posteriors_by_restatement(spark):
    import xxhash

    rng = random.Random(4)
    found = [(k, " ".join(rng.choice(("alpha beta gamma" if k % 3 else "delta Beta omega").split()) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(70, None), (71, "new")]
    known = {k: "a" if k % 3 else "b" for k in range(0, 60, 2)}
    feature = lambda w: xxhash.xxh64(w.lower().encode(), seed=42).intdigest() % mixing.FEATURES
    words = {k: [feature(w) for w in (t or "").split()] for k, t in found}
    prior = {d: np.log((sum(v == d for v in known.values()) + 1) / (len(known) + 2)) for d in "ab"}
    seen = {d: [w for k, v in known.items() if v == d for w in words[k]] for d in "ab"}
    logs = {w: {d: np.log((seen[d].count(w) + mixing.SMOOTHING) / (len(seen[d]) + mixing.SMOOTHING * mixing.FEATURES)) for d in "ab"} for w in {*seen["a"], *seen["b"]}}
    got = mixing.mix(corpus.frame(spark, found), spark.createDataFrame(list(known.items()), "id long, domain string"), {"a": 0.5, "b": 0.5}).collect()
    for r in got:
        own = words[r.id]
        s = {d: prior[d] + sum(logs[w][d] - sum(logs[w].values()) / 2 for w in own if w in logs) / max(len(own), 1) ** 0.5 for d in "ab"}
        assert abs(r.p_a - 1 / (1 + np.exp(s["b"] - s["a"]))) < 1e-9


def test_mixing_of_many_repeats_and_labels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "LABELLED", 3)
    found = [(1, "alpha beta")] * 50 + [(k, "gamma") for k in range(2, 9)]
    labels = spark.createDataFrame([(k, "a" if k < 3 else "b") for k in range(9)], "id long, domain string")
    got = mixing.mix(corpus.frame(spark, found), labels, {"a": 0.5, "b": 0.5}).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in found)


def test_mixing_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "id long, domain string")
    assert mixing.mix(corpus.frame(spark, []), labels, {"a": 1.0}).count() == 0
    got = mixing.mix(corpus.frame(spark, corpus.rows()[:20]), labels, {"a": 0.5, "b": 0.5}, budget=1.0).collect()
    assert len(got) == 20 and all(r.p_a == r.p_b == 0.5 for r in got)


def test_span_hashes_tell_spans_apart():
    from meshledger.llm import common

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 70_000).astype(np.uint8)
    start = np.arange(len(data) - 12)
    for seed in (1, 2):
        h = common.span_hashes(data, start, start + 12, seed)
        kinds = {data[i:i + 12].tobytes() for i in start}
        assert len(kinds) == len(np.unique(h)) == len({(data[i:i + 12].tobytes(), int(x)) for i, x in zip(start, h)})
    zeros = np.zeros(100, np.uint8)
    assert len(np.unique(common.span_hashes(zeros, np.zeros(100, int), np.arange(1, 101), 3))) == 100


def test_reading_a_shard_opens_each_rule_once(monkeypatch):
    """Documents are put together from opened rules, not by opening the symbols of the whole shard level by level."""
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 400, 300)
    docs = [np.r_[passage[:rng.integers(0, 300)], rng.integers(0, 400, 5)].astype(np.uint32) for _ in range(60)] + [np.zeros(0, np.uint32)]
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    shard = repair.Shard.read(repair.encode(np.concatenate(docs), first, 400, 2))
    opened, expand = [], repair.Shard.expand
    monkeypatch.setattr(repair.Shard, "expand", lambda self, symbols: opened.append(len(symbols)) or expand(self, symbols))
    flat, at = shard.documents()
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[*d.tolist(), 2] for d in docs]
    assert len(shard.rules) and sum(opened) <= len(shard.rules)


def test_a_grammar_does_not_depend_on_the_slots_of_its_pairs(monkeypatch):
    rng = np.random.default_rng(9)
    ids = np.tile(rng.integers(0, 30, 500), 6).astype(np.uint32)
    ids[rng.integers(0, len(ids), 300)] = 31
    want = repair.encode(ids, np.array([0, 1000, len(ids)]), 40, 2)
    monkeypatch.setattr(repair, "_MULTIPLIER", np.uint64(0))  # all pairs share one slot
    assert repair.encode(ids, np.array([0, 1000, len(ids)]), 40, 2) == want
