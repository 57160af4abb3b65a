"""Chat repair, token output and whitening against brute force, and on hard rows."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import chat_repair, queries, token_output, whitening
from marlstone.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# 11: chat repair


def least_edits(rows):
    """(cost, audit, repaired) by dynamic programming over suffixes: rows of (role, text, fault)."""
    grammar = re.compile(r"(s?(ua)+)?")
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    @functools.lru_cache(None)
    def best(i, state, added=0):
        out = []
        if i == len(rows) and state in "0a":
            out.append((0, "", ()))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = best(i + 1, state)
            out.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = 1 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    c, a, r = best(i + 1, step[state, role[:1]])
                    out.append((c + more, "K" + a, ((role, text), *r)))
                for x in "ua":
                    if (state, x) in step:
                        c, a, r = best(i + 1, step[state, x])
                        out.append((c + 2 + more, "R" + a, ((name[x], text), *r)))
        if added < 3:
            for x in "ua":
                if (state, x) in step:
                    c, a, r = best(i, step[state, x], added + 1)
                    out.append((c + 2, "I" + a, ((name[x], ""), *r)))
        return min(out, key=lambda t: t[:2]) if out else (10**9, "", ())

    cost, audit, repaired = best(0, "0")
    assert grammar.fullmatch("".join(r[0] for r, _ in repaired))
    return cost, audit, repaired


def brute_repair(turns):
    """The report of each conversation from rows (conv_id, turn, role, text) after damage."""
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        seen, faulty = set(), []
        for _, _, role, _, text in rows:
            shown = text.strip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        known = [r[1] for r in rows if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[0][:1] for r in faulty]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, repaired = least_edits(tuple(faulty))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *[sum(r[2] == f for r in faulty) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string, part int, chunk string, digest string"


def turns_of(spark, rows):
    """Turns with columns whose names the operator uses itself."""
    return Scratch(spark, "test").keep(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS))


def random_turns(seed, conversations, longest):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(pick.randint(1, longest)):
            rows.append((conv, pick.choice([None, *range(9)]), pick.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), pick.choice([None, "", " \n", "Yes.", "no", "What? ", "ok!\t", "so.so", "é…", f"{pick.random()}."])))
    return rows


@pytest.mark.parametrize(("chunk", "longest", "conversations"), [(4096, 7, 120), (3, 25, 25), (1, 12, 20)])
def test_repair_matches_brute_force(spark, chunk, longest, conversations):
    rows = [*random_turns(chunk, conversations, longest), (None, 1, "user", "Hi."), (None, None, None, None), (None, 3, "assistant", "Ho."), (-5, None, "user", "x" * 100000 + ".")]
    got = chat_repair.conversations(turns_of(spark, rows), chunk).collect()
    want = brute_repair(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in REPORT) == want[r.conv_id], r.conv_id


def test_one_conversation_of_all_rows(spark):
    pick = random.Random(5)
    rows = [(7, pick.randint(0, 10**6), pick.choice(["user", "assistant", "system"]), pick.choice(["Same.", "cut", f"{pick.random()}!"])) for _ in range(600)]
    (got,) = chat_repair.conversations(turns_of(spark, rows), 50).collect()
    assert tuple(got[c] for c in REPORT) == brute_repair(rows)[7]


def test_repair_of_nothing_and_its_rows(spark):
    assert chat_repair.conversations(turns_of(spark, [])).count() == 0
    rows = chat_repair.repair(turns_of(spark, [(1, 0, "assistant", "A."), (1, 1, "assistant", "B")])).orderBy("part", "chunk").collect()
    assert ("".join(r.audit for r in rows), sum(r.cost for r in rows)) == ("RK", 3)
    assert [(x.role, x.text) for r in rows for x in r.repaired] == [("user", "A."), ("assistant", "B")]


def test_repair_query_matches_brute_force(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = []
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            rows += [row] * (2 if kind == 3 else 1)
    want = brute_repair(rows)
    got = queries.op11_chat_repair(spark, SF).collect()
    assert {r.conv_id for r in got} == {t[0] for t in turns} and len(got) == len({t[0] for t in turns})
    for r in got:
        assert tuple(r[c] for c in REPORT) == want.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def test_damage_keeps_hard_rows(spark):
    rows = [(None, None, None, None), (1, 1, "user", "a."), (1, None, None, "b")]
    kinds = {r: zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20 for r in rows}
    assert queries.damaged(turns_of(spark, rows)).count() == sum(0 if k == 0 else 2 if k == 3 else 1 for k in kinds.values())


# 12: token output

TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two, three."), (4, "one two, three."), (4, "Other."), (None, "no id"), (None, None), (9, "Éa é don't STOP... <|endoftext|> <|ENDOFTEXT|> x y \x85 ½ ǅ Σας\x1cq"), (7, "word " * 60000), (-3, "文字 и слова 🙂🙂 a.b,c;d a1b2 ...,,, it's it'S")]


def documents_of(spark, rows):
    return Scratch(spark, "test").keep(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, ids string, shard int, start long").repartition(3))


def check_tokens(rows, got):
    plain = Tokenizer.from_file(WORDS)
    want = {}
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(got, key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in want.items()}


@pytest.mark.parametrize("docs_a_segment", [4096, 2])
def test_token_files_round_trip(spark, docs_a_segment):
    scratch = Scratch(spark, "tokens")
    token_output.write_token_files(documents_of(spark, TEXTS), scratch.root, WORDS, segment_docs=docs_a_segment)
    check_tokens(TEXTS, token_output.token_digests(spark, scratch.root).collect())
    some = token_output.stored_tokens(spark, scratch.root, [4, 9]).collect()
    plain = Tokenizer.from_file(WORDS)
    assert sorted(list(r.ids) for r in some) == sorted([*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in TEXTS if d in (4, 9))


def test_token_query_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_tokens(rows, queries.op12_token_output(spark, SF).collect())


def test_token_files_of_nothing_and_a_strange_dictionary(spark):
    scratch = Scratch(spark, "tokens")
    token_output.write_token_files(documents_of(spark, []), scratch.root, WORDS)
    assert token_output.token_digests(spark, scratch.root).count() == 0
    with pytest.raises(Exception, match="needs the dictionary"):
        spark.createDataFrame([(0, 0, 0, 2, "other", 1, 1, [1], [0, 1], [1], b"x")], token_output.SEGMENTS).write.mode("append").parquet(f"{scratch.root}/segments")
        token_output.token_digests(spark, scratch.root).collect()


def test_words_are_encoded_as_in_whole_texts():
    plain, encode = Tokenizer.from_file(WORDS), token_output.Encoder(WORDS, 1)
    assert encode.by_word and encode.lowers
    pick = random.Random(1)
    letters = "abcXYZéÉßßΣσς文🙂'.,;:!?<|>/0129½́  \t\n\x0b\x0c\r\x1c\x85'sS"
    for _ in range(3000):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 30)))
        assert np.frombuffer(encode(text.encode()), "<u2").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encode = Tokenizer.from_file(path), token_output.Encoder(path, 1)
    assert not encode.by_word
    assert np.frombuffer(encode(b" a b  c"), encode.kind).tolist() == [*plain.encode(" a b  c", add_special_tokens=False).ids, 1]


def test_a_shared_dictionary_makes_short_documents_smaller(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    import zstandard

    dictionary = token_output.train_dictionary(docs, WORDS)
    encode = token_output.Encoder(WORDS, 1)
    short = [encode(r.text.encode()) for r in docs.filter("n_chars < 600").collect()]
    shared = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    alone = zstandard.ZstdCompressor()
    assert sum(len(shared.compress(x)) for x in short) < 0.9 * sum(len(alone.compress(x)) for x in short)


# 13: whitening


def vectors_of(spark, rows):
    return Scratch(spark, "test").keep(spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, x string, component int").repartition(3))


def brute_whitening(rows, most=16):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:most]
    values, vectors = values[order], vectors[:, order]
    out = defaultdict(list)
    for i, v in x:
        away = n * np.array(v, object) - sums
        out[i].append((int((away**2).sum()), (away.astype(float) / n) @ vectors / np.sqrt(values), values / np.trace(covariance), n))
    return out


@pytest.mark.parametrize("tile", [32, 3])
def test_whitening_matches_brute_force(spark, tile):
    pick = np.random.default_rng(3)
    rows = [(i, (pick.normal(size=10) * np.arange(1, 11)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(150, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (200, None), (201, [*rows[0][1][:9], float("nan")]), (202, [*rows[0][1][:9], None]), (203, [*rows[0][1][:9], float("-inf")])]
    want = brute_whitening(rows)
    got = defaultdict(list)
    for r in whitening.whiten(vectors_of(spark, rows), tile=tile).collect():
        got[r.vec_id].append(r)
    assert set(got) == set(want)
    for i, found in got.items():
        assert len(found) == 10 * len(want[i])
        assert {r.deviation for r in found} == {w[0] for w in want[i]}
        for w in want[i]:
            own = sorted((r for r in found if r.deviation == w[0]), key=lambda r: r.component)
            assert np.allclose(np.abs([r.whitened for r in own]), np.abs(w[1]), rtol=1e-9, atol=1e-9)
            assert np.allclose([r.explained for r in own], w[2], rtol=1e-9) and own[0].n == w[3]
            assert own[0].identity_error < 1e-9
    signs = {(r.vec_id, r.component): np.sign(r.whitened) for f in got.values() for r in f if r.vec_id == 150}
    assert all(np.sign(r.whitened) == signs[150, r.component] for r in got[0] if r.deviation == want[0][0][0])


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    (one,) = whitening.whiten(vectors_of(spark, [(1, [2.0]), (2, None)])).collect()
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, None, None)
    flat = whitening.whiten(vectors_of(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0]), (4, [1.0])])).collect()
    assert {r.vec_id for r in flat} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])])).collect()
    assert len(huge) == 6 and all((r.deviation is None) == (r.vec_id != 3) for r in huge)


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_whitening(rows)
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    for r in got:
        (w,) = want[r.vec_id]
        assert r.deviation == w[0] and r.n == w[3] and abs(r.explained - w[2][r.component - 1]) < 1e-9 and r.identity_error < 1e-4
        assert abs(abs(r.whitened) - abs(w[1][r.component - 1])) < 1e-6
