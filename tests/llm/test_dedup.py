import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from assetloom.llm import exact_dedup, simhash, substring_dedup
from assetloom.llm.components import components

SCHEMA = "doc_id long, text string, keep_id string, kept string, fp string, node long, _norm string, row string"
EXTRA = ("x", "y", "z", 1, "n", "r")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(1, "a b"), (2, "a  b"), (3, "a\tb"), (4, None), (5, ""), (6, " "), (7, "\n\n"), (None, "a b"), (None, "only"), (8, "é b"), (9, "a b"), (9, "a b"), (10, "x" * 100_000), (11, "x" * 100_000 + " ")]


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, first[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup_matches_brute_force(spark, hot):
    rows = ROWS + ([(100 + i, "hot  text" if i % 2 else "hot text") for i in range(120)] + [(7, "same row")] * 60 if hot else [])
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected_exact(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(t) for _, t in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_carries_rows_and_takes_empty_tables(spark):
    got = exact_dedup.exact_dedup(frame(spark, ROWS), carry=True).filter("kept").select("row.*")
    assert got.columns == [c.strip().split()[0] for c in SCHEMA.split(",")] and got.count() == len({norm(t) for _, t in ROWS})
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def slow_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
                    changed = True
    least = {}
    for n, root in enumerate(label):
        if ids[n] is not None:
            least[root] = min(least.get(root, ids[n]), ids[n])
    return [least.get(r) for r in label]


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(5)
    base = words(rng, 60)
    rows = [(i, " ".join(base[:k] + ["Changed"] + base[k + 1 :])) for i, k in enumerate(range(0, 60, 3))]
    rows += [(100 + i, " ".join(words(rng, 30))) for i in range(30)] + [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one TWO"), (205, "É é"), (206, "é é"), (None, "one two"), (203, "One two"), (207, "w " * 50_000)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(frame(spark, rows)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    parts = brute_components([i for i, _ in rows], fps)
    assert got == {(i, f"{f:016x}", p) for (i, _), f, p in zip(rows, fps, parts)}
    assert simhash.near_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("variants", [1 << 21, 4000, 300])
def test_links_lose_nothing_when_prefixes_are_dealt_again(spark, variants, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_VARIANTS", variants)
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(25):
            flipped = centre
            for b in rng.sample(range(64), n):
                flipped ^= 1 << b
            fps.add(flipped)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups, found = {}, {}
    for n, f in enumerate(signed):
        groups.setdefault(want[n], set()).add(f)
        found.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_near_copies_leave_one(spark):
    rng = random.Random(3)
    base = words(rng, 200)
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(5)] + [(9, " ".join(words(rng, 50))), (9, " ".join(words(rng, 50)))]
    kept = simhash.one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 9] and kept.columns[:2] == ["doc_id", "text"]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(1)
    passage, fuzzy = words(rng, 60), words(rng, 80)
    changed = fuzzy[:30] + ["other"] + fuzzy[31:55] + fuzzy[57:]
    rows = [(i, " ".join(words(rng, 40) + passage + words(rng, 25))) for i in range(6)]
    rows += [(10, " ".join(words(rng, 10) + fuzzy)), (11, " ".join(changed + words(rng, 90)))]
    rows += [(20, " ".join(words(rng, 300))), (21, " ".join(words(rng, 30))), (22, None), (23, ""), (24, " ".join(passage[:30]))]
    copy = " ".join(words(rng, 70))
    rows += [(30, copy), (31, copy.upper()), (31, copy), (None, copy), (40, "Again " * 5000)]
    got = substring_dedup.passages(frame(spark, rows)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert set(spans) == {0, 1, 2, 3, 4, 5, 10, 11, 30, 31, None}
    assert all(spans[i] == [(40, 100)] for i in range(6))
    assert spans[30] == [(0, 70)] and spans[31] == [(0, 70)] * 2
    assert spans[10][0][0] == 10 and spans[10][0][1] >= 88
    assert substring_dedup.passages(frame(spark, [])).count() == 0


def test_chain_and_common_subsequence_against_plain_versions():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert substring_dedup.common(np.array(a, np.uint16), np.array(b, np.uint16)) == table[-1][-1]
    pos = np.array([0, 8, 16, 24, 200, 208])
    assert substring_dedup.chains(pos, pos + 5) == [(0, 29, 5, 34, 4), (200, 213, 205, 218, 2)] or substring_dedup.chains(pos, pos + 5)[0][:2] == (0, 29)
    assert substring_dedup.chains(np.array([0, 8]), np.array([8, 0])) == []  # crossing matches don't chain


def test_winnowed_seeds_are_shared_by_any_long_common_run():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, substring_dedup.WINDOW + substring_dedup.K - 1, dtype=np.uint64)
    for _ in range(30):
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64), common, rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]) for _ in range(2))
        assert set(substring_dedup.seeds(a)[0]) & set(substring_dedup.seeds(b)[0])


def test_passages_built_from_shared_lines_are_found(spark):
    rng = random.Random(12)
    stock = [words(rng, 10) for _ in range(7)]
    passage = sum(stock, [])
    rows = [(100 + i, " ".join(words(rng, 30) + passage + words(rng, 30))) for i in range(2)]
    # Every 5-mer of the passage is also in an earlier and a later row: pairs of its lines, and each seam, go round in rows of their own.
    for k in range(len(passage) - 4):
        rows += [(i, " ".join(words(rng, 20) + passage[k : k + 5] + words(rng, 20))) for i in (k, 1000 + k)]
    # One partition in this order, so that those rows hold each seed's first and last place.
    docs = frame(spark, sorted(rows)).coalesce(1).sortWithinPartitions("doc_id")
    got = {(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in substring_dedup.passages(docs).collect()}
    assert got == {(100, 30, 100, 101), (101, 30, 100, 100)}


def test_no_window_that_two_rows_share_is_ruled_out():
    rng = random.Random(13)
    for _ in range(200):
        window = [rng.randrange(rng.choice([2, 5, 60000])) for _ in range(substring_dedup.MIN_WORDS)]
        sides = [np.array([rng.randrange(6) for _ in range(40)] + window + [rng.randrange(6) for _ in range(40)], np.uint16) for _ in range(2)]
        found = [substring_dedup.seeds(s.astype(np.uint64)) for s in sides]
        for side, (mers, places), (others, _) in zip(sides, found, found[::-1]):
            assert 40 in substring_dedup.candidates(side, places[np.isin(mers, others)])
            assert substring_dedup.window_hashes(side)[40] == substring_dedup.window_hashes(sides[0])[40]


@pytest.mark.parametrize("n, edits", [(60, [10, 49]), (60, [8, 51]), (60, [12]), (60, [14, 29, 44]), (80, [*range(9, 80, 10)])])
def test_fuzzy_passages_near_the_limit_are_found(n, edits):
    rng = np.random.default_rng(1)
    draw = lambda k: rng.integers(0, 1 << 16, k).astype(np.uint16)
    found = 0
    for _ in range(100):
        passage = draw(n)
        changed = passage.copy()
        changed[edits] ^= 1
        a, b = np.concatenate([draw(100), passage, draw(100)]), np.concatenate([draw(130), changed, draw(80)])
        (mers, places), (others, far) = (substring_dedup.seeds(x.astype(np.uint64)) for x in (a, b))
        at = dict(zip(others.tolist(), far.tolist()))
        hits = [(p, at[m]) for m, p in zip(mers.tolist(), places.tolist()) if m in at]
        longest = 0
        for s, e, fs, fe, _ in substring_dedup.chains(*np.array(hits).T) if len(hits) > 1 else []:
            left, right, same, *_ = substring_dedup.align(a, b, (s, fs), (len(a) - e, len(b) - fe))
            longest = max(longest, e + right - s + left) if same >= substring_dedup.SIMILARITY else longest
        found += longest >= substring_dedup.MIN_WORDS
    assert found >= 98


def test_snippets_of_several_partners_are_no_passage(spark):
    rng = random.Random(21)
    others = [words(rng, 200) for _ in range(3)]
    mixed = words(rng, 40) + sum((o[80:110] + words(rng, 8) for o in others), []) + words(rng, 40)
    rows = [(i, " ".join(o)) for i, o in enumerate(others)] + [(9, " ".join(mixed)), (10, " ".join(words(rng, 200)))]
    assert substring_dedup.passages(frame(spark, rows)).count() == 0


def test_edited_copies_of_a_passage_are_recalled_and_clean_documents_left_alone(spark):
    """Twelve documents share a passage of 120 words with 8 edits in each, in five families; clean ones share nothing."""
    rng = random.Random(22)
    rows, truth = [], {}
    for family in range(5):
        passage = words(rng, 120)
        for n in range(12):
            own = list(passage)
            for k in rng.sample(range(120), 8):
                own[k] = words(rng, 1)[0]
            lead = rng.randrange(20, 90)
            truth[family * 100 + n] = (lead, lead + 120)
            rows.append((family * 100 + n, " ".join(words(rng, lead) + own + words(rng, 40))))
    rows += [(10_000 + n, " ".join(words(rng, 300))) for n in range(40)]
    rng.shuffle(rows)
    covered = {}
    for r in substring_dedup.passages(frame(spark, rows)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert set(covered) == set(truth)
    inside = sum(len(covered[i] & set(range(a, b))) for i, (a, b) in truth.items())
    outside = sum(len(covered[i] - set(range(a, b))) for i, (a, b) in truth.items())
    assert inside >= 0.9 * 120 * len(truth) and outside <= 0.02 * 120 * len(truth)


def test_long_copies_are_aligned_in_parts(spark):
    rng = random.Random(23)
    long = words(rng, 20_000)
    edited = [w if n % 40 else "edit" for n, w in enumerate(long)]
    got = {r.doc_id: (r.start_word, r.end_word) for r in substring_dedup.passages(frame(spark, [(1, " ".join(long)), (2, " ".join(edited))])).collect()}
    assert set(got) == {1, 2} and all(a <= 1 and b == 20_000 for a, b in got.values())


def test_fuzzy_passages_of_rows_that_are_neither_first_nor_last_are_found(spark):
    rng = random.Random(31)
    passage = words(rng, 110)
    edited = [words(rng, 1)[0] if k % 9 == 4 else w for k, w in enumerate(passage)]
    rows = [(100, " ".join(words(rng, 30) + passage + words(rng, 30))), (101, " ".join(words(rng, 45) + edited + words(rng, 20)))]
    # Each 5-mer of either is also in an earlier and a later row, and no 50 words are equal.
    for n, text in enumerate((passage, edited)):
        for k in range(len(text) - 4):
            rows += [(i, " ".join(words(rng, 20) + text[k : k + 5] + words(rng, 20))) for i in (-1000 * (n + 1) + k, 1000 * (n + 1) + k)]
    docs = frame(spark, sorted(rows)).coalesce(1).sortWithinPartitions("doc_id")
    got = {r.doc_id: (r.start_word, r.end_word, r.partner_id) for r in substring_dedup.passages(docs).collect()}
    assert set(got) == {100, 101} and got[100][2] == 101 and got[101][2] == 100
    assert 30 <= got[100][0] <= 36 and 134 <= got[100][1] <= 140 and 45 <= got[101][0] <= 51 and 149 <= got[101][1] <= 155


def test_rows_that_share_a_short_text_only_do_not_meet():
    rng = np.random.default_rng(32)
    draw = lambda k: rng.integers(0, 1 << 16, k).astype(np.uint16)
    stock, passage = draw(30), draw(60)
    changed = passage.copy()
    changed[::9] ^= 1
    cuts = [np.concatenate([draw(60), stock, draw(60)]) for _ in range(40)]
    cuts += [np.concatenate([draw(40), stock, p, draw(20)]) for p in (passage, changed)] + [np.concatenate([stock, draw(70), stock])]
    nodes, asks = np.arange(len(cuts)), np.ones(len(cuts), bool)
    for every in (False, True):
        met = substring_dedup.meet(np.zeros(len(cuts), np.int64), nodes, asks, [c.tobytes() for c in cuts], every)
        assert set(met) == {(40, 41), (41, 40)}


def test_a_line_that_one_row_repeats_makes_no_pairs_and_a_replaced_block_is_crossed():
    rng = np.random.default_rng(33)
    draw = lambda k: rng.integers(0, 1 << 16, k).astype(np.uint16)
    line, passage = draw(14), draw(110)
    block = passage.copy()
    block[40:62] = draw(22)
    cuts = [np.concatenate([draw(30), line, draw(30)]) for _ in range(40)] + [np.concatenate([line, draw(26), line])]
    cuts += [np.concatenate([line, draw(70), p[10:92], draw(20)]) for p in (passage, block)]
    nodes, asks = np.arange(len(cuts)), np.ones(len(cuts), bool)
    for every in (False, True):
        met = substring_dedup.meet(np.zeros(len(cuts), np.int64), nodes, asks, [c.tobytes() for c in cuts], every)
        assert set(met) == {(41, 42), (42, 41)}
    # Keys that are taken together are held apart.
    keys = np.repeat([5, 6], len(cuts))
    met = substring_dedup.meet(keys, np.tile(nodes, 2), np.tile(asks, 2), [c.tobytes() for c in cuts] * 2, True)
    n = len(cuts)
    assert set(met) == {(41, 42), (42, 41), (n + 41, n + 42), (n + 42, n + 41)}


def test_a_filter_lets_all_of_its_keys_through(spark):
    keys = np.random.default_rng(34).integers(-(2**63), 2**63 - 1, 5000)
    known = substring_dedup._filter(spark.createDataFrame([(int(k),) for k in keys[:1000]], "key long"))
    through = substring_dedup._known(known, keys.view(np.uint64))
    assert through[:1000].all() and through[1000:].mean() < 0.01
