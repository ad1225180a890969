"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import make_docs, prose, vocabulary

from tidemark.llm import best_fit, merkle, turn_alignment


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if (i ^ 1) < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def leaf(row):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(levels_of([leaf(r) for r in by_lang[lang]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            path = siblings(trees[k], i) + siblings(top, k)
            found = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                found[3] += 1
            acc = leaf(found)
            for digest, left in path:
                acc = sha(acc) if digest is None else sha(digest, acc) if left else sha(acc, digest)
            root = top[-1][0]
            out.append((row[0], trees[k][0][i], trees[k][-1][0], root, sha(*[d or "" for d, _ in path]), acc, acc == root))
    return sorted(out, key=repr)


def manifest_rows(docs):
    from pyspark.sql import functions as F

    out = merkle.verified_manifest(docs).withColumn("proof", F.expr("sha2(array_join(transform(path, s -> coalesce(s.digest, '')), ''), 256)"))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=repr)


def test_manifest_of_hard_documents(hard_docs):
    rows = [tuple(r) for r in hard_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_rows(hard_docs) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 64, 65, 4097])
def test_manifest_over_several_stored_levels(spark, n):
    docs = make_docs(spark, [f"text {i}" for i in range(n)]).selectExpr("* EXCEPT (lang)", "if(doc_id % 50 = 7, null, 'en') AS lang")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_rows(docs) == plain_manifest(rows)


def test_manifest_of_nothing(no_docs):
    assert merkle.verified_manifest(no_docs).count() == 0


def test_tampering_is_seen_and_nothing_else(spark):
    docs = make_docs(spark, ["a b c"] * 200)
    got = {r["doc_id"]: r["verified"] for r in merkle.verified_manifest(docs).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(200)}


# Operator 12


def symbol(kind, forced, extra):
    return chr(64 + kind + 4 * forced + 8 * extra)


SYMBOLS = [symbol(k, f, e) for k in range(4) for f in (0, 1) for e in (0, 1) if not (f and e)]


def every_script(symbols):
    """Least (cost, audit) over all edit scripts, by trying them."""
    codes = [ord(c) - 64 for c in symbols]
    found = []

    def go(i, roles, cost, audit, inserted):
        if cost > 3 * len(codes):
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserted < 2:
            for c in "ua":
                go(i, roles + c, cost + 2, audit + "I", inserted + 1)
        if i < len(codes):
            kind, forced, extra = codes[i] & 3, codes[i] >> 2 & 1, codes[i] >> 3 & 1
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not forced:
                go(i + 1, roles + "?sua"[kind], cost + extra, audit + "K", 0)
                for c in "ua":
                    go(i + 1, roles + c, cost + extra + 2, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def chained(symbols, size):
    parts = [symbols[i : i + size] for i in range(0, len(symbols), size)]
    options = [turn_alignment.piece_options(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)]
    places = [sorted({o[3] for o in os}) for os in options]
    cost, taken = turn_alignment.chain([[(*o[:3], at.index(o[3])) for o in os] for os, at in zip(options, places, strict=True)])
    return cost, "".join(os[i][3] for os, i in zip(options, taken, strict=True))


def test_cheapest_least_audit():
    rng = random.Random(1)
    for _ in range(250):
        symbols = "".join(rng.choice(SYMBOLS) for _ in range(rng.randint(1, 4)))
        expected = every_script(symbols)
        for size in (1, 2, 256):
            assert chained(symbols, size) == expected, (symbols, size)


def test_pieces_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(150):
        symbols = "".join(rng.choice(SYMBOLS) for _ in range(rng.randint(5, 60)))
        whole = chained(symbols, 1000)
        assert {chained(symbols, size) for size in (4, 11, 25)} == {whole}


def plain_repair(rows):
    """Expected result by conv_id of (conv_id, turn, role, text) rows after damage, with ``chained`` for the audit."""
    white = " \t\n\x0b\x0c\r"
    out = {}
    for conv, turns in rows.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        seen, symbols, faults = set(), "", [0, 0, 0]
        for _, role, text in turns:
            body = text.strip(white)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            symbols += symbol("?sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 0, fault in (0, 1), fault == 2)
        cost, audit = chained(symbols, 1000) if symbols else (0, "")
        pairs = zip(turns, turns[1:], strict=False)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        size = sum(c != "D" for c in audit)
        said, at, j = [], 0, 0
        for c in audit:
            given = "user" if (j - size % 2) % 2 == 0 else "assistant"
            if c == "I":
                said.append(f"{given}:")
            else:
                if c != "D":
                    said.append(f"{turns[at][1] if c == 'K' else given}:{turns[at][2]}")
                at += 1
            j += c != "D"
        out[conv] = (gaps, *faults, illegal, cost, audit, sha("\n".join(said)))
    return out


def plain_damage(table):
    rows = {}
    for conv, turn, role, text in table:
        kept = rows.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return rows


def repaired(spark, table):
    schema = "conv_id bigint, turn bigint, role string, text string, stage string, at string, block string, options string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in table], schema)
    got = turn_alignment.repaired_conversations(df, turn_alignment.damaged(df)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_repaired_conversations(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "User", "tool", "", None]
    texts = ["Yes.", "No", "Why?\n", "", "  ", None, "Ünï!", "a\n\nb.", "x" * 50000 + "."]
    table = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            said = rng.choice(texts) if rng.random() < 0.4 else f"Line {rng.random()}."
            table.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(roles), said))
    table += [(500, t, "user" if t % 2 else "assistant", f"Turn {t}" + "." * (t % 3)) for t in range(900)]  # four pieces
    table += [(501, 3, "user", "Same.")] * 40  # one row many times
    table += [(502, t, "system", None) for t in range(30)]
    table += [(conv, 0, "user", "Gone.") for conv in range(600, 700)]  # some lose every row
    expected = plain_repair(plain_damage(table))
    assert any(e == (0,) * 6 + ("", sha("")) for e in expected.values())
    assert repaired(spark, table) == expected


def test_no_conversations(spark):
    assert repaired(spark, []) == {}


# Operator 13


def fill(made, histogram):
    """Rows (offset, length) of each sequence; every rank of every length has one place."""
    by_length, out = {}, {}
    for p in made.placements:
        by_length.setdefault(p.length, []).append(p)
    for n, count in histogram.items():
        at = by_length[n]
        for p, end in zip(at, [*[q.first for q in at[1:]], count], strict=True):
            for r in range(end - p.first):
                out.setdefault(p.sequence + r // p.each, []).append((p.offset + r % p.each * n, n))
    return out


def gapless(rows, capacity):
    at = 0
    for offset, n in sorted(rows):
        if offset != at:
            return False
        at += n
    return at <= capacity


def fewest(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_keeps_an_optimum():
    """What the reduction fixes, and the fewest sequences of the rest, are the fewest of all."""
    rng = random.Random(5)
    fixed = 0
    for _ in range(250):
        capacity = rng.randint(5, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        made = best_fit.plan(Counter(items), capacity)
        rooms = fill(made, Counter(items))
        assert all(gapless(r, capacity) for r in rooms.values()) and sorted(rooms) == list(range(made.sequences))
        rest = [n for s, r in rooms.items() if s >= made.fixed for _, n in r]
        assert made.fixed + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity), (items, capacity)
        fixed += made.fixed
    assert fixed > 200


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(6)
    small = {n: rng.randint(1, 9) for n in range(1, 2049)}
    made = best_fit.plan(small)
    large = best_fit.plan({n: c * 10**8 + rng.randint(0, 9) for n, c in small.items()})
    assert len(large.placements) < 20000 and len(made.placements) < 20000
    assert large.sequences <= 1.01 * sum(n * c * 10**8 for n, c in small.items()) / 2048 + 2048


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packed_documents(hard_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    expected = []
    for (doc, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        expected += [(doc, k // 2048, k, len(ids[k : k + 2048]), ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    packed = best_fit.packed_documents(hard_docs, path()).cache()
    got = packed.collect()
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"]))) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(gapless(v, 2048) for v in by.values())
    total = sum(r["length"] for r in got)
    assert len(by) == -(-total // 2048)
    whole = {r["sequence_id"]: (r["length"], bytes(r["ids"])) for r in best_fit.sequences(packed).collect()}
    for s, rows in by.items():
        assert whole[s][0] == sum(n for _, n in rows) and len(whole[s][1]) == 4 * whole[s][0]
    one = got[0]
    assert whole[one["sequence_id"]][1][4 * one["offset"] : 4 * (one["offset"] + one["length"])] == bytes(one["ids"])


def test_tokens_of_odd_texts(spark):
    rng, vocab = random.Random(3), vocabulary()
    texts = ["\x1c a\x85b\xa0c　d", "<|endoftext|> x<|startoftext|>", "ΑΣ ΣΑΣ İI", "é ́e", "don't I'LL", "x" * 30000, prose(rng, 3000, vocab), "​", "漢字 かな"]
    got = {r["doc_id"]: r for r in best_fit.token_pieces(make_docs(spark, texts), path(), 1 << 20).collect()}
    assert [bytes(got[i]["ids"]) for i in range(len(texts))] == [ids.tobytes() for ids in plain_ids(texts)]


def test_words_by_pieces_are_the_tokenizers():
    """Random words of letters, digits, signs, apostrophes, composed and decomposed letters; the memory of pieces may be small."""
    rng, encoder = random.Random(4), best_fit._Encoder(path())
    assert encoder.own
    letters = "aAbsStTrReEvVmMlLdD0159.,!_-<|>'ÀÖöøßſŸİıʼné\u0301×÷ńŁ¹²\x00\x7f"
    made = list({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(8000)})
    for part in (made[:4000], made[4000:], []):
        words, flat, sizes = encoder.encoded(part)
        assert sorted(words) == sorted(part) and sizes.sum() == len(flat)
        ends = np.cumsum(sizes)
        for w, n, end in zip(words, sizes, ends, strict=True):
            assert flat[end - n : end].tolist() == encoder.tokenizer.encode(w, add_special_tokens=False).ids, w
        encoder._forget()


def test_equal_rows_and_nothing(spark, no_docs):
    docs = make_docs(spark, ["one two three four"] * 3000, [7] * 3000)
    got = best_fit.packed_documents(docs, path()).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in got)[1:] == [409] * (len(got) - 1) and sum(r["count"] for r in got) == 3000
    assert best_fit.packed_documents(no_docs, path()).count() == 0
