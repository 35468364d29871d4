"""Operators against the libraries, brute force and exact round trips, on small fixtures with the awkward cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strokelake.llm import chat, classifier, common, fingerprints, licences, lines, neardup, packing, pieces, rules, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall oak tree near the old mill"
TEXTS = [
    None,
    "",
    " ",
    "one",
    "two words",
    BASE,
    BASE,
    BASE.replace("seven", "eight"),
    BASE + "\n" + BASE + "\n" + BASE,
    "Multiple   spaces\tand\ttabs \n and trailing ",
    "İstanbul ΣΑΣ it's 1,234.5 «quoted». x<|endoftext|>y <|startoftext|> \0 nul",
    "日本語のテキスト。🎉🎉 café CAFÉ é",
    "▁mark ▁ and <s> </s> <0x0A>",
    "x" * 3000,
    "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, 7) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again", 7), (None, "an orphan row", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_tokens string, length long")


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = common.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = tokens.token_counts(docs, path).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "an orphan row" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert tokens.token_counts(empty, path).count() == 0
    import sentencepiece

    path = common.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in tokens.token_counts(docs.filter("doc_id is not null"), path).collect():
        assert r.n_tokens == len(library.encode(TEXTS[r.doc_id] or ""))


def test_long_text_is_cut_at_safe_boundaries():
    path = common.vocabulary("byte_bpe_50k.json")
    counter = tokens.ByteLevelCounter(path)
    text = " lead  double " + "some words, and more words. " * 30_000
    assert counter.counts([text]) == [len(counter.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_pieces_equal_the_library_with_spans(docs, empty):
    import sentencepiece

    path = common.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_pieces(docs.filter("doc_id is not null"), path).collect():
        text = TEXTS[r.doc_id] or ""
        proto = library.encode(text, return_type="proto")
        assert r.ids == library.encode(text) and r.decoded == library.decode(library.encode(text))
        assert list(zip(r.begins, r.ends)) == [(p.begin, p.end) for p in proto.pieces]
        assert b"".join(text.encode()[b:e] for b, e in zip(r.begins, r.ends)) == text.encode()
    assert pieces.encode_pieces(empty, path).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs, path).drop("decoded"), path).filter("doc_id = 5").first()
    assert back.decoded == BASE


def test_character_map_follows_the_longest_prefix():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    chars = pieces.CharacterMap(spec.precompiled_charsmap)
    for text in ("ﬁ ½  ㍿ ｱｲｳ é", "  a　b\tc  ", "ｶﾞ 한", "plain", "", "   "):
        out, source = pieces.normalise(text.encode(), chars, True, True)
        assert out.decode() == library.normalize(text) or not text.strip()
        assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all()


def test_token_pieces_and_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = common.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = tokens.token_pieces(docs.filter("doc_id is not null"), path, limit=64, with_ids=True)
    placed = packing.place(common.checkpoint(found), capacity=64).collect()
    for key, group in itertools.groupby(sorted(placed, key=lambda r: (r.doc_id, r.piece)), key=lambda r: r.doc_id):
        if key == 5 or key == 6:
            continue
        group, ids = list(group), library.encode(TEXTS[key] or "", add_special_tokens=False).ids + [0]
        assert [i for r in group for i in r.ids] == ids
        assert [r.start for r in group] == list(range(0, len(ids), 64))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in group)
    check_sequences(placed, 64)
    whole = packing.assemble(spark.createDataFrame(placed))
    assert sum(len(r.ids) for r in whole.collect()) == sum(r.length for r in placed)
    assert packing.place(tokens.token_pieces(empty, path)).count() == 0


def check_sequences(placed, capacity):
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_near_the_lower_bound(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1 + rng.exponential(120, 3000).astype(int), 512)
    rows = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    placed = packing.place(rows, capacity=512).collect()
    assert len(placed) == 3000
    assert check_sequences(placed, 512) <= -(-int(lengths.sum()) // 512) * 1.01 + 1


def test_packing_refuses_impossible_lengths(spark):
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), capacity=8)


TURNS = [
    (1, 0, "system", "be [brief] \\ <now>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\s and \\\\b [/SYS]"), (1, 3, "user", None), (1, 4, "assistant", "x " * 900), (1, 5, "tool", "[ROLE]"), (1, 6, "assistant", "end"),
    (2, 0, "assistant", ""), (3, 0, "system", "alone"), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (4, 0, None, "no role"),
    *((5, i, ("user", "assistant")[i % 2], f"turn {i} says a few words") for i in range(30)),
    (6, 0, "system", "rules " * 200), (6, 1, "user", "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8" * 20), (6, 2, "assistant", "\u3042" * 40), (6, 3, "user", "so"),
    (7, 0, "user", "same"), (7, 0, "user", "same"), (7, 1, "assistant", "twice"), (7, 1, "assistant", "twice"), (8, None, "assistant", "first"), (8, 0, "system", "late"),
]


def brute_windows(rows, counts, budget, history):
    """(shown turns, first new place, tokens) of each window, from the whole list of turns."""
    lead = [0] if rows[0][2] == "system" else []
    out, new = [], len(lead)
    if lead and counts[0] >= budget:
        out, lead = [([0], 0, counts[0])], []
    room = budget - sum(counts[i] for i in lead)
    while new < len(rows):
        back = [i for i in range(max(new - history, 1 if rows[0][2] == "system" else 0), new)] if out and (new > 1 or rows[0][2] != "system") else []
        while back and sum(counts[i] for i in back) + counts[new] > room:
            back = back[1:]
        end = new + 1
        while end < len(rows) and sum(counts[i] for i in [*back, *range(new, end + 1)]) <= room:
            end += 1
        shown = [*lead, *back, *range(new, end)]
        out.append((shown, 0 if not out else len(lead) + len(back), sum(counts[i] for i in shown)))
        new = end
    return out or [([0], 0, counts[0])]


@pytest.mark.parametrize("budget, history", [(64, 2), (40, 0), (200, 5), (100_000, 2)])
def test_chat_windows_round_trip_and_masks(spark, budget, history):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    frame = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, windows string").repartition(3)
    made = common.checkpoint(chat.format_conversations(frame, budget, history))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    windows = {}
    for r in sorted(made.collect(), key=lambda r: r.window):
        windows.setdefault(r.conv_id, []).append(r)
    marks = lambda role: chat.MARKS.get(role) or ("[ROLE]" + role + "[/ROLE][INST]", "[/INST]")
    code = lambda t: t.replace("\\", "\\b").replace("[", "\\s").replace("<", "\\l")
    for conv in {t[0] for t in TURNS}:
        mine = sorted(((t[0], -1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv), key=lambda t: t[1])
        assert [(t.role, t.text) for t in back[conv].turns] == [(t[2], t[3]) for t in mine]
        assert back[conv].loss_text == "".join(t[3] for t in mine if t[2] == "assistant")
        texts = [marks(t[2])[0] + code(t[3]) + marks(t[2])[1] for t in mine]
        counts = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        want = brute_windows(mine, counts, budget, history)
        assert back[conv].formatted_chars == sum(map(len, texts)) and len(windows[conv]) == len(want)
        for r, (shown, new, tokens) in zip(windows[conv], want):
            assert r.text == "".join(texts[i] for i in shown) and r.fresh == sum(len(texts[i]) for i in shown[:new])
            assert r.n_tokens == tokens and r.over_budget == (tokens > budget) and (tokens <= budget or len(shown) - new == 1)
            assert [r.text[s.start : s.end] for s in r.spans] == [code(mine[i][3]) for i in shown[new:] if mine[i][2] == "assistant"]
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def brute_rules(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_rules_equal_brute_force(docs, empty):
    for r in rules.apply_rules(docs.filter("doc_id is not null")).collect():
        want = brute_rules(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    assert rules.apply_rules(empty).count() == 0
    assert rules.keep_passing(empty).columns == empty.columns


def test_rule_order_changes_no_verdict(spark):
    long = " ".join(f"word{i} reads plainly" for i in range(40))
    texts = [long, long.upper() + "!", long.replace("plainly", "$$$ ###"), " ".join("12 34" for _ in range(60)) + long[:40]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = rules.default_rules()
    first = {r.doc_id: r.kept for r in rules.apply_rules(frame, rules=made).collect()}
    assert first == {r.doc_id: r.kept for r in rules.apply_rules(frame, rules=made[::-1], sample_rows=1).collect()}
    assert first[0] and not first[1] and not first[2]
    assert {r.doc_id for r in rules.keep_passing(frame, rules=made).collect()} == {k for k, v in first.items() if v}


def jaccard(a, b, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [WORD.findall(t)] for i in range(max(len(w) - n + 1, 1))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_fingerprints(spark, docs, empty):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 9000, 6000)]
    texts = [" ".join(words[a : a + 900]) for a in (0, 100, 300, 600, 1800)] + ["", "a b", BASE, BASE]
    frame = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted(fingerprints.edited_fingerprints(frame).collect())
    prints = {}
    for k, r in enumerate(got):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for mine, other in ((r.near_edited, edited), (r.near_next, after)):
            want = 1.0 if not text and not other else 0.0 if not text or not other else jaccard(text, other, 5)
            assert abs(mine - want) < 0.16
        prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.edited_fingerprints(docs).count() == len(TEXTS) + 2
    assert fingerprints.edited_fingerprints(empty).count() == 0


def brute_groups(texts, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))) if w else frozenset()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rng = np.random.default_rng(words)
    texts = [None, "", "one", "one", "Two words", "two WORDS", "two words more"]
    for size in (30, 120, 400):
        for _ in range(4):
            base = [f"v{i}" for i in rng.integers(0, 5000, size)]
            for edits in (0, 0, 1, 2, 3, 4, 6, 9):  # chains and stars of edited copies
                copy = list(base)
                for at in rng.integers(0, size, edits):
                    copy[at] = f"u{rng.integers(0, 5000)}"
                texts.append(" ".join(copy))
                if edits % 2:
                    base = copy
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, id string").repartition(5)
    got = sorted(neardup.near_duplicates(frame, neardup.Settings(words=words, percent=percent)).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute_groups(texts, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_a_large_group(spark):
    """Copies with few to many edits, shared edits, cut copies and a common passage: links that no hub sees are found too."""
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in rng.integers(0, 5000, 150)]
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(base)]
    for k in range(150):
        copy = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 12)):
            copy[at] = f"u{rng.integers(0, 5000)}"
        texts.append(" ".join(copy))
        if k % 5 == 0:  # a twin far from the base
            copy[int(rng.integers(0, 150))] = "twin"
            texts.append(" ".join(copy))
        if k % 7 == 0:
            texts.append(" ".join(base[: int(rng.integers(60, 150))]))
        if k % 6 == 0:
            texts.append(" ".join(base + passage[: int(rng.integers(10, 60))]))
        texts.append(" ".join([f"w{i}" for i in rng.integers(0, 9000, 80)] + passage))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(neardup.near_duplicates(frame).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute_groups(texts, 3, 85)


def test_near_duplicates_of_awkward_rows(spark, docs, empty):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2 and [r for r in got if r.doc_id is None][0].kept
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (500, 450)], "a long, b long")
    for few in (1 << 17, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(neardup, "FEW_LINKS", few)
            found = {r.node: r.component for r in neardup.components(links).collect()}
        assert all(found[i] == 0 for i in range(201)) and found[500] == found[450] == 400 and len(found) == 204
    assert neardup.components(links.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one), (5, two), (3, one), (5, two), (7, two + " more"), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect())
    assert got == [(3, 38, 3, True), (5, 38, 3, False), (5, 38, 5, True), (5, 38, 5, True), (7, 39, 5, False), (8, 0, 8, True)]
    left = neardup.first_of_group(frame.withColumn("kept", common.F.lit(1)))
    assert left.columns == ["doc_id", "text", "kept"] and sorted((r.doc_id, r.text) for r in left.collect()) == [(3, one), (5, two), (5, two), (8, "")]


def test_near_duplicates_without_broadcasts(spark):
    """The same rows when nothing counts as small."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for k in range(60):
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            copy[at] = f"u{rng.integers(0, 5000)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neardup, "maybe_broadcast", lambda rows: rows)
        patch.setattr(neardup, "FEW_LINKS", 0)
        got = sorted(neardup.near_duplicates(frame).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute_groups(texts, 3, 85)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_line_dedup_equals_brute_force(spark, broadcast_bytes):
    rng = np.random.default_rng(1)
    bases = ["".join(rng.choice(list("abcde fgh"), 24 + k)) + "z" for k in range(6)]
    texts = [None, "", "short\nshort\nshore", "short\n\n" + " " * 30 + "\n" + " " * 30, "é" * 25 + "\n" + "é" * 26]
    for _ in range(40):
        made = []
        for _ in range(4):
            line = bases[rng.integers(len(bases))]
            at, kind = rng.integers(len(line)), rng.integers(5)
            made.append([line, line[:at] + "Q" + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + "R" + line[at:], line[:at] + "QR" + line[at + 1 :]][kind])
        texts.append("\n".join(made))
    frame = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, _n int").repartition(3)
    got = sorted(lines.dedup_lines(frame, broadcast_bytes=broadcast_bytes).collect(), key=lambda r: r.doc_id)
    earlier, want = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            near = lambda e: min(len(e), len(line)) >= lines.MIN_CHARS and distance_one(line, e)
            if not line.strip() or not any(line == e or near(e) for e in earlier):
                kept.append(line)
            earlier.append(line)
        want.append(None if t is None else "\n".join(kept))
    assert [r.text for r in got] == want
    assert [r.n_lines for r in got] == [0 if t is None else t.count("\n") + 1 for t in texts]


def test_long_lines_one_edit_apart(spark):
    """Lines around and over the length from which they are cut, with edits at the ends, inside and at the cuts."""
    rng, texts = np.random.default_rng(2), []
    for size in (512, 513, 514, 700, 5000):
        base = "".join(rng.choice(list("abcdé fg"), size - 1)) + "."
        step = max(64, int(np.ceil(np.sqrt(size))))
        texts.append(base)
        for at in (0, 1, step - 1, step, size // 2, size - step, size - 1):
            texts += [base[:at] + "Q" + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + "R" + base[at:], base[:at] + "QQ" + base[at + 2 :] + "QQ"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [int(any(t == e or distance_one(t, e) for e in texts[:i])) for i, t in enumerate(texts)]
    assert [r.n_dropped for r in sorted(lines.dedup_lines(frame).collect(), key=lambda r: r.doc_id)] == want and 0 < sum(want) < len(want)


def test_near_copies_vary_only_where_they_may_differ(spark):
    """Lines that share a half but differ in several places cost a row a segment, not one a character."""
    line = "".join(chr(97 + k * k % 23) + str(k % 10) for k in range(100))
    far = [line[:a] + "#" * 9 + line[a + 9 :] + f"{a:05d}" * 3 for a in range(100, 190, 9)]
    rows = [(i, t) for i, t in enumerate([line, line[:50] + "!" + line[51:], *far])]
    frame = spark.createDataFrame(rows, "_place long, _line string")
    varied = lines.segment_variants(lines.shared_segments(frame))
    assert {r._place for r in varied.select("_place").distinct().collect()} == {0, 1} and varied.count() < len(line)
    hashed = frame.withColumns({"_h1": lines.F.col("_place"), "_h2": lines.F.col("_place")})
    assert [r._h1 for r in lines.near_lines(hashed).collect()] == [1]


def test_very_long_lines_are_workable(spark):
    line = "".join(chr(97 + k * k % 23) + str(k % 10) for k in range(100_000))
    frame = spark.createDataFrame([(0, line), (1, line[:77_777] + "#" + line[77_778:]), (2, line[1:]), (3, line[:100] + "##" + line[100:])], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in lines.dedup_lines(frame).collect()) == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_line_dedup_of_awkward_rows(docs, empty):
    got = lines.dedup_lines(docs)
    assert got.count() == len(TEXTS) + 2 and set(docs.columns) <= set(got.columns)
    assert lines.dedup_lines(empty).count() == 0


def test_line_dedup_stage_keeps_documents_with_short_lines(spark):
    import corpus_pipeline

    shared = "this long line stands in every one of the documents"
    texts = [shared, f"roses are red\n{shared}\nviolets are blue", f"{shared}\n", f"{shared}\n \t\n{shared}", f"{shared}\nx = 1"]
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, frame, "").collect()}
    assert got == {0: (shared, len(shared)), 1: ("roses are red\nviolets are blue", 30), 4: ("x = 1", 5)}


def test_line_dedup_of_short_lines_is_exact(spark):
    texts = ["a verse\n\nof short\n  ", "a verse\nof shore\n\nof short\nyes", None, "yes\nyes!\n  "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()}
    assert got == {0: texts[0], 1: "of shore\n\nyes", 2: None, 3: "yes!\n  "}
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame, min_chars=3).collect()}
    assert got == {0: texts[0], 1: "\nyes", 2: None, 3: "  "}


def test_line_dedup_without_edits_is_exact(spark):
    long = "a line of more than twenty characters"
    texts = [long, f"{long}!\n{long}", f"{long}!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in lines.dedup_lines(frame, edits=0).orderBy("doc_id").collect()] == [long, f"{long}!", ""]
    assert [r.text for r in lines.dedup_lines(frame).orderBy("doc_id").collect()] == [long, "", ""]
    with pytest.raises(ValueError):
        lines.dedup_lines(frame, edits=2)


#: Every name that an operator or its result uses inside, as a column of the caller's.
INSIDE = sorted({n for f in ("lines", "neardup", "packing", "common") for n in re.findall(r"[\"' .(]([_a-z][_a-z0-9]{0,15})[\"' ,)]", open(f"strokelake/llm/{f}.py").read())})


def test_columns_of_any_name_go_with_their_rows(spark):
    import corpus_pipeline

    shared = "this long line stands in every one of the documents"
    texts = [shared, f"roses are red\n{shared}\nviolets are blue", None, f"{shared}\nx = 1", " ".join(f"word{i}" for i in range(60))]
    texts.append(texts[-1])
    extra = [n for n in INSIDE if n not in ("doc_id", "text", "n_chars", "length", "piece")]
    assert {"_dropped", "_id", "_hash", "_text_hash", "_salt", "_rank", "_length", "sequence_id", "n_lines", "c0", "c1"} <= {*extra, "c0", "c1", "sequence_id"}
    extra = sorted({*extra, "c0", "c1", "sequence_id"})
    rows = [(i, t, 7, 40 + i, 0, *[f"{i} {n}" for n in extra]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars long", "length long", "piece int", *[f"`{n}` string" for n in extra]])).repartition(2)
    own = lambda r, but=(): all(r[n] == f"{r['doc_id']} {n}" for n in extra if n not in but)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == 6 and all(own(r, ("n_lines", "n_dropped")) for r in got) and [r.n_dropped for r in sorted(got, key=lambda r: r.doc_id)] == [0, 1, 0, 1, 0, 1]
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns and all(map(own, got.collect())) and got.count() == 5
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and all(map(own, got.collect())) and got.count() == 5
    got = packing.place(docs, 64).collect()
    assert len(got) == 6 and all(own(r, ("sequence_id", "offset")) and r.length == 40 + r.doc_id for r in got)
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.columns == docs.columns and all(map(own, got.collect()))


def test_licences(spark, docs, empty):
    mit = licences.TEMPLATES["MIT"][2]
    texts = ["Intro.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "prose and RELEASED under the  MIT license. And on.", mit, mit.replace("Software", "Program"), "the license of a plain text", None, "", "This work is licensed under the GNU General Public License, version 3."]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licence string")
    got = {r.doc_id: r for r in licences.scan(frame).collect()}
    assert [got[i].licence for i in range(8)] == ["Apache-2.0", "MIT", "MIT", "MIT", None, None, None, "GPL-3.0"]

    def dice(a, b):
        x, y = set(licences.template_bigrams(a)), set(licences.template_bigrams(b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0

    for i, t in enumerate(texts):  # every passage against every template, without pruning
        parts = {t or ""} | {s for line in (t or "").split("\n") for s in [line, *re.split(r"(?<=[.!?])[\x20\x09-\x0D]+", line)]}
        best = max(dice(p, x) for p in parts for ts in licences.TEMPLATES.values() for x in ts)
        assert got[i].dice == pytest.approx(best if best >= 0.8 else 0)
    assert licences.scan(docs).count() == len(TEXTS) + 2 and licences.scan(empty).count() == 0


def test_licences_over_several_lines_and_sentences(spark):
    import textwrap

    prose = "A first line of plain prose stands here.\nAnd a second one, which says nothing at all.\n"
    wrap = lambda name, k: "\n".join(" * " + line for line in textwrap.wrap(licences.TEMPLATES[name][k], 60))
    bsd = "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n"
    mit, mpl = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["MPL-2.0"][0]
    texts = [
        prose + bsd + prose,
        prose + wrap("MIT", 2) + "\n" + " ".join(f"w{i}" for i in range(400)),
        wrap("GPL-3.0", 1) + "\n" + prose + wrap("ISC", 0) + "\n" + prose,
        " ".join(f"w{i}." for i in range(200)) + " " + mpl + " " + " ".join(f"x{i}" for i in range(200)),
        prose + bsd + prose + bsd + prose,
        prose + "Licensed under the MIT License.\nLicensed under\nthe Apache License,\nVersion 2.0.\n" + prose,
        prose * 3 + "the license file is used by this source code",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.licence, round(r.dice, 6), r.n_matches) for r in licences.scan(frame).collect()}
    assert got[0] == (["BSD-3-Clause"], "BSD-3-Clause", 1.0, 1) and got[1] == (["MIT"], "MIT", 1.0, 1)
    assert got[2] == (["GPL-3.0", "ISC"], "GPL-3.0", 1.0, 2) and got[3] == (["MPL-2.0"], "MPL-2.0", 1.0, 1)
    assert got[4] == (["BSD-3-Clause"], "BSD-3-Clause", 1.0, 2) and got[5] == (["Apache-2.0", "MIT"], "Apache-2.0", 1.0, 2)
    assert got[6] == ([], None, 0.0, 0)


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(0)
    prose = lambda: " ".join(rng.choice("the of and river stone walks under light with many small words".split(), 60))
    junk = lambda k: " ".join(w.upper() + "!!" for w in prose().split()) if k % 2 else " ".join(w + "$$$" for w in prose().split())
    texts = [prose() if i % 5 else junk(i) for i in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = classifier.fit(frame, labels)
    got = classifier.score(frame, model).withColumn("held_out", classifier.held_out(common.F.col("doc_id"))).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and np.mean([(r.score >= 0.3) == (r.doc_id % 5 != 0) for r in held]) > 0.97
    assert classifier.score(docs, model).count() == len(TEXTS) + 2 and classifier.score(empty, model).count() == 0
    assert classifier.filter_quality(docs, model).columns == docs.columns
    none = classifier.fit(frame, labels.limit(0))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}


def test_pipeline_stages_hold(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows
        rows = common.checkpoint(stage(spark, before, folder))
        assert rows.columns == columns and 0 < rows.count() <= before.count(), name
        if name == "quality_rules":
            want = {r.doc_id for r in rules.apply_rules(before).collect() if r.kept}
            assert {r.doc_id for r in rows.collect()} == want
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in sorted(before.collect())]
            groups = brute_groups([t for _, t in texts], 5, 80)
            assert {r.doc_id for r in rows.collect()} == {texts[i][0] for i, (_, g) in enumerate(groups) if g == i}
    check_sequences(corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect(), 2048)
