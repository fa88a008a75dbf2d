import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetloom.llm import bpe, packing, secrets, sharding
from assetloom.llm.queries import PACK_ENCODER, op3_mincost_flow_sharding

SCHEMA = "doc_id long, text string, start string, length string, shard string, size string, spans string"
TEXTS = [None, "", " ", "a", "Hello  world\n\n it's  2024", "é ü\tß", "日本語のテキスト 🎉", "<|endoftext|> x", "word " * 3000, "z" * 30_000, "ab" * 4000, "՘ old letter", "a b \x1c\x85 c"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", "l", "h", "z", "p") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    own = bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_encoding_equals_the_library_and_decodes_to_the_text(spark, reference):
    own, library = reference
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "'", "12", ".", "é", "\x1c", "the", "zqx", "日", " "]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text[:50]
        assert own.decode(ids).decode() == text


def test_encoding_forgets_and_is_still_right(reference, monkeypatch):
    own, library = reference
    from assetloom.llm.pieces import Pieces

    small = Pieces(own.pieces.split, own.pieces.pieces.make, b",", most=4)
    text = "many different words here, and here many more words"
    assert list(map(int, small.joined(text).split(b","))) == library.encode_ordinary(text)


def test_digests(spark, reference):
    _, library = reference
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for r in bpe.encode_digests(frame(spark, TEXTS), path, P.PATTERN).collect():
        text = TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = bpe.encode(frame(spark, TEXTS[:6]), path, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (TEXTS[r.doc_id] or "") for r in whole)
    assert bpe.encode_digests(frame(spark, []), path, P.PATTERN).count() == 0


def test_packing_places_each_id_once(spark):
    tokenizer = Tokenizer.from_file(PACK_ENCODER[0])
    rng = random.Random(1)
    texts = TEXTS + [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 900))) for _ in range(300)]
    rows = packing.pack(frame(spark, texts), PACK_ENCODER).toPandas()
    total = 0
    for doc, own in rows.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        own = own.sort_values("start")
        assert own.start.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist() and own.length.sum() == len(ids)
        assert (own.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.concatenate([[0], own.length.cumsum()[:-1]]).tolist() and own.length.sum() <= 2048
    assert rows.doc_id.nunique() == len(texts) and total / (2048 * rows.sequence_id.nunique()) > 0.95
    assert packing.pack(frame(spark, []), PACK_ENCODER).count() == 0


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = random.Random(2)
    for _ in range(100):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randrange(1, 80))), reverse=True)
        room, want = [], []
        for n in lengths:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            room += [50] if at == len(room) else []
            want.append((at, 50 - room[at]))
            room[at] -= n
        bins, offsets = packing.first_fit_decreasing(np.array(lengths), 50)
        assert list(zip(bins.tolist(), offsets.tolist())) == want


def slow_base(text):
    kinds = ("assign", "access", "hex")
    found = [(m.start(), 0, m.end()) for m in secrets._ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "ſecret", "secret", '"', "'", " ", "=", ":", "abcdef", "x/y+z==", "AKIA" + "A" * 16, "AKIA", "0a" * 12, "deadbeef", "é", "\n"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for r in secrets.scan(frame(spark, texts)).collect():
        base = slow_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id]
        assert r.n_assign == base.count("assign:") and r.n_access == base.count("access:") and r.n_hex == base.count("hex:")
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert secrets.scan(frame(spark, [])).count() == 0


def test_lexer_propagates_constants_and_scores_names():
    found = lambda text: [text[s:e] for s, k, e in secrets.spans(text)[1] if secrets.KINDS[k] == "literal"]
    value = "Zx9" + "qW7" * 4
    assert found(f'a = "{value}"\nclient_credential = a\n') == [value]
    assert found(f'part = "{value}"\nsigningKey = "pre-" + part') == [value]
    assert found(f"private-key: {value}") == [value]
    assert found(f'colour = "{value}"') == [] and found('password_hint = "rosebud"') == []
    assert found("auth: ${ENV_VALUE}") == [] and found('passphrase = "changeme"') == []
    assert found(f'if key == "{value}": pass') == []


def test_redaction_replaces_secrets_only(spark):
    text = "before token = abcdef123456 after AKIA" + "B" * 16 + " end"
    got = secrets.redact(frame(spark, [text, None, "clean text"])).collect()
    assert got[0].text == "before <secret> after <secret> end" and got[1].text is None and got[2].text == "clean text"


def check_shards(rows, n, tolerance):
    sizes = dict.fromkeys(range(n), 0)
    for r in rows:
        sizes[r.shard] += r["size"]
    for shard in range(n):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert max(sizes.values()) - min(sizes.values()) <= tolerance


def test_resharding_of_odd_rows(spark):
    texts = TEXTS + ["same"] * 200 + [None] * 20
    docs = frame(spark, texts)
    rows = sharding.reshard(docs, 4, F.pmod("doc_id", F.lit(3))).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    check_shards(rows, 4, 31_000)
    assert sharding.reshard(frame(spark, []), 4, F.lit("x")).count() == 0


def test_resharding_of_documents_is_even(spark):
    rows = op3_mincost_flow_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and {r.law for r in rows} == {"bytes"}
    check_shards(rows, 24, 6000)


def test_minimum_cost_flow_moves_the_fewest_bytes():
    rng = random.Random(8)
    for _ in range(40):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        supply = [rng.randint(0, 50) for _ in range(n)]
        total = sum(supply)
        capacity = [total // m + (j < total % m) for j in range(m)]
        home = sharding.homes(supply, m)
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: int(home.get(i) != j))
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == capacity
        moved = sum(v for (i, j), v in flow.items() if home.get(i) != j)
        assert moved == total - sum(min(supply[i], capacity[j]) for i, j in home.items())


def test_general_costs_equal_brute_force():
    from itertools import product

    rng = random.Random(6)
    for _ in range(30):
        supply, capacity = [rng.randint(0, 3) for _ in range(2)], [3, 3]
        price = [[rng.randint(0, 5) for _ in range(2)] for _ in range(2)]
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: price[i][j])
        got = sum(v * price[i][j] for (i, j), v in flow.items())
        best = min(a * price[0][0] + (supply[0] - a) * price[0][1] + b * price[1][0] + (supply[1] - b) * price[1][1] for a, b in product(range(supply[0] + 1), range(supply[1] + 1)) if a + b <= 3 and sum(supply) - a - b <= 3)
        assert got == best


def test_rewriting_only_what_changed(spark, tmp_path):
    docs = frame(spark, [f"text {i}" for i in range(100)])
    placed = sharding.reshard(docs, 3, F.pmod("doc_id", F.lit(2)), carry=True)
    changed = sharding.rewrite(placed, f"file://{tmp_path}/out")
    assert 2 in changed and spark.read.parquet(f"file://{tmp_path}/out").count() > 0


def test_a_literal_beyond_its_base_span_is_redacted_whole():
    for text in ('password = "Hunter2!Secret$99"', 'api_key: "AKIA' + "B" * 16 + '!tail#77"', 'signing_key = "' + "0a" * 12 + '-Zx9!qW7"'):
        found = secrets.spans(text)[1]
        value = text[text.index('"') + 1 : -1]
        assert (text.index(value), 3, text.index(value) + len(value)) in found
        assert not set(secrets.redacted(text, found).replace("<secret>", "").rpartition('"')[0]) & set("!$#")
    assert secrets.spans('token = "abcdef123456"')[1] == [(0, 0, 21)]


def test_long_literals_long_sums_and_later_lines_are_read():
    found = lambda text: [text[s:e] for s, k, e in secrets.spans(text)[1] if secrets.KINDS[k] == "literal"]
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZghijklmnopqrstuvwxyz234567") for _ in range(n))
    long, parts = draw(6000), [draw(12) for _ in range(40)]
    assert found(f'private_key_credential = "{long}"') == [long]
    assert found("signing_passphrase = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert found("credential =\n  " + "\n  + ".join(f'"{p}"' for p in parts[:3])) == parts[:3]
    assert found("credential = " + " +\n  ".join(f'"{p}"' for p in parts[:3])) == parts[:3]
    chain = f'a0 = "{parts[0]}"\n' + "".join(f"a{n + 1} = a{n} + a{n}\n" for n in range(60)) + "dsn_credential = a60"
    assert found(chain) == [parts[0]]
    assert found("credentials:\n  name2: plain\n") == [] and found("AUTH_CREDENTIAL=\nOTHER_VALUE1=abc") == []


def test_resharding_tells_any_number_of_old_shards_apart(spark):
    docs = frame(spark, [f"text {i}" for i in range(2100)])
    rows = sharding.reshard(docs, 4, F.pmod("doc_id", F.lit(700))).collect()
    olds = {}
    for r in rows:
        olds.setdefault(r.old_shard, set()).add(r.doc_id % 700)
    assert len(rows) == 2100 and len(olds) == 700 and all(len(names) == 1 for names in olds.values())
    check_shards(rows, 4, 40)


def test_transfers_of_many_old_shards_move_the_fewest_bytes():
    rng = random.Random(9)
    for n in (0, 1, 3, 7, 600, 2000):
        sizes, m = [rng.randint(0, 50) for _ in range(n)], 5
        total = sum(sizes)
        capacity = [total // m + (j < total % m) for j in range(m)]
        home, flow = sharding.homes(sizes, m), sharding.transfers(sizes, capacity)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == sizes if n < 10 else sum(flow.values()) == total
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == capacity
        assert sum(v for (i, j), v in flow.items() if home.get(i) != j) == total - sum(min(sizes[i], capacity[j]) for i, j in home.items())


def test_packing_keeps_ids_beside_nulls_and_takes_long_white_space(spark):
    from assetloom.llm import packing
    from assetloom.llm.queries import PACK_ENCODER

    big = (1 << 60) + 1
    rows = [(big, "one two"), (big + 2, "three"), (None, "four"), (None, None), (big, "one two"), (5, " " * 1_000_000), (6, "\n" * 1_000_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PACK_ENCODER).collect()
    assert sorted((str(r.doc_id) for r in got if r.doc_id is None or r.doc_id > 6)) == sorted(map(str, [big, big, big + 2, None, None]))
    slow = packing.Ids(PACK_ENCODER[0], None, None)
    for doc, text in rows[-2:]:
        own = [r for r in got if r.doc_id == doc]
        assert sum(r.length for r in own) == len(slow.of(text)) + 1 == own[0].doc_tokens
