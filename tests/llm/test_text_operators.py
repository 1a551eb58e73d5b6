import hashlib
import json
import random
import re
import string
import struct
import zlib

import numpy as np
import pytest
from helpers import docs, sample, words
from pyspark.sql import functions as F

from foretell.llm import pii, quality, records, unigram
from foretell.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_quality_counts(spark):
    texts = [t for t in sample() if len(t or "") < 3000] + ["a b c d e\na b c d e\n\n \n a b c d e", "# $ <x> " * 4 + "\x0b\x0c\x1c z\u00a0z", "a b c d e f g h i j k"]
    got = {r.doc_id: r for r in quality.quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), repr(t)[:80]
        assert not (r.kept and r.base_failed)


def brute_kept(text):
    """The bands again, without the operator's own functions."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    raw = (text or "").encode()

    def good(part):
        least, most = next((a, b) for n, a, b in quality.BANDS if len(part) < n)
        return least <= len(part) / len(z.compress(part)) <= most

    if brute_quality(text)[-1] or not raw or not good(raw):
        return False
    chunks = [raw[i : i + 4096] if i + 4096 <= len(raw) else raw[-4096:] for i in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    return 5 * sum(not good(c) for c in chunks) <= len(chunks)


def test_verdicts_against_plain_python(spark):
    rng = random.Random(9)
    some = [words(rng, n) for n in (5, 12, 40, 100, 300, 700, 1500, 2500)]
    texts = some + [" ".join(rng.choices(words(rng, k).split(), k=n)) for k in (3, 10, 40) for n in (20, 200, 900, 2500)]
    texts += [some[-1] + " " + "".join(rng.choices(string.printable[:94], k=n)) for n in (100, 2000, 5000, 12_000)] + [some[-1] + " ab" * n for n in (50, 3000)] + [None, "", "x" * 5000, "\u00e9 " * 3000]
    rows = [(i % 5 or None, t) for i, t in enumerate(texts)] + [(7, some[3])] * 3  # unknown and repeated ids: each row stands alone
    got = sorted(tuple(r) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).fillna(-1, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == sorted((d or -1, *brute_quality(t), brute_kept(t)) for d, t in rows)
    assert {r[-1] for r in got} == {True, False}


def test_quality_windows_both_ways(monkeypatch):
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(rng.randint(0, 200))] for _ in range(60)]
    short = [quality.repeat_words(w) for w in lists]
    monkeypatch.setattr(quality, "LONG", 0)
    assert [quality.repeat_words(w) for w in lists] == short


def test_bands_keep_prose_and_reject_extremes(spark):
    rng = random.Random(1)
    prose = words(rng, 2000)
    junk = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + (" " if i % 60 == 59 else "") for i in range(9000))
    flat = " ".join(f"row{i % 997} x" for i in range(3)) + " " + "lorem ipsum dolor sit amet " * 3 + " ".join(f"a{i}" for i in range(3))
    hidden = prose + " " + " ".join("z" * 400 + str(i) for i in range(60))
    got = {r.doc_id: r for r in quality.quality(docs(spark, [prose, junk, flat, hidden, "x" * 200_000])).collect()}
    assert got[0].kept and not got[1].kept and not got[3].kept and not got[4].kept
    kept = quality.keep_good(docs(spark, [prose, junk, None]))
    assert kept.columns == docs(spark, ["x"]).columns and [r.doc_id for r in kept.collect()] == [0]


def test_quality_empty_table(spark):
    assert quality.quality(docs(spark, ["x"]).limit(0)).count() == 0


# token records


def test_records_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = sample() + ["a <|endoftext|>b<|startoftext|>", "It's I'LL we've", "\u00c9T\u00c9 e\u0301 \u65e5\u672c \u0130stanbul", "a\u00a0b\u3000c\x1cd"]
    d = docs(spark, texts)
    place, done = records.write_records(d, path, files=3)
    got = sorted(records.read_records(spark, place, done).collect())
    start = 0
    for (doc, at, n, crc), text in zip(got, texts, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), doc
        start += n
    part, n, _ = done[0]
    order = [*range(n)][::-1]
    back = list(records.read_at(place, part, order))
    assert [b[0] for b in back] == [r.doc_id for r in got[:n]][::-1] and len(back[-1][1]) == got[0].n_tokens


def test_ids_are_the_librarys_on_latin_text():
    """The short way for words of ASCII and Latin-1 characters, against the library on whole texts."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    t, mine = Tokenizer.from_file(path), records.WordEncoder(text)
    assert mine.plain
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]]
    kinds = [letters, list("abcdefghijklmnopqrstuvwxyz"), list("aeiou'\u00e9\u00e8\u00c9stdmlr"), list("0123456789.,-ab"), [*letters, "\u0301", "\u0130", "\u00a0", "\u00aa", "\u00b5", "\u0178", "\u212a", "\u65e5"]]
    texts = [" ".join("".join(rng.choices(k, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for k in kinds for _ in range(400)]
    texts += ["".join(chr(c) for c in range(0x20, 0x250)), "'S 'T'RE 'Ve\u00d7\u00f7 \u00df\u1e9e", "x<|endoftext|>y <|", "<|startoftext|>"]
    for x, got in zip(texts, mine(texts), strict=True):
        assert np.frombuffer(got, mine.width).tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], x


def test_words_that_return_are_encoded_once(monkeypatch):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        mine = records.WordEncoder(f.read())
    monkeypatch.setattr(records, "MEMO", 50)
    made, word = [], mine.word
    monkeypatch.setattr(mine, "word", lambda w: made.append(w) or word(w))
    texts = [f"the of word{i} other{i}" for i in range(400)]
    got = [mine([t, None, t.encode()]) for t in texts]
    assert made.count(b"the") == made.count(b"of") == 1 and len(made) == 802
    assert all(a == c and len(b) == 2 for a, b, c in got) and len(mine.memo) + len(mine.former) <= 100
    assert got == [records.WordEncoder(mine.tokenizer.to_str())([t, None, t]) for t in texts[:3]] + got[3:]


def test_slices_end_at_either_bound(monkeypatch):
    monkeypatch.setattr(records, "SLICE_ROWS", 3)
    monkeypatch.setattr(records, "SLICE_BYTES", 10)
    texts = [b"a", None, b"b", b"c" * 20, b"d", b"e" * 9, b"f"]
    assert list(records.slices(list(range(7)), texts)) == [([0, 1, 2], texts[:3]), ([3], texts[3:4]), ([4, 5], texts[4:6]), ([6], texts[6:])] and not list(records.slices([], []))


def test_records_ties_nulls_and_empty(spark):
    path = tokenizer_path("word_bpe_49k.json")
    d = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string")
    got = records.read_records(spark, *records.write_records(d, path)).collect()
    assert len(got) == 4 and sorted((r.doc_id or -1) for r in got) == [-1, 1, 1, 1] and min(got, key=lambda r: r.start).doc_id is None
    assert records.read_records(spark, *records.write_records(d.limit(0), path)).count() == 0


def test_records_of_very_long_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["word " * 300_000, "a" * 60_000, "\u65e5\u672c" * 5_000]
    got = records.read_records(spark, *records.write_records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, files=2)).orderBy("doc_id").collect()
    t = Tokenizer.from_file(path)
    for r, text in zip(got, texts, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_records_notice_damage(tmp_path):
    import io

    whole = records.frame(b"hello") + records.frame(b"")
    assert list(records.frames(io.BytesIO(whole))) == [b"hello", b""]
    for i in range(len(records.frame(b"hello"))):
        broken = bytearray(whole)
        broken[i] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(records.frames(io.BytesIO(bytes(broken))))


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces(tokenizer_path("piece_bpe_32k.model"))


def brute_path(m, segment):
    b = segment.encode()
    known = {m.text[i].encode(): i for i in range(len(m.text)) if m.kind[i] in (unigram.NORMAL, unigram.USER_DEFINED)}
    heads = [i for i in range(len(b)) if b[i] & 0xC0 != 0x80] + [len(b)]
    best = {0: (0, [])}
    for x, e in enumerate(heads[1:], 1):
        for y, s in enumerate(heads[:x]):
            w = b[s:e]
            if w in known:
                gain, ids = int(m.score[known[w]]), [known[w]]
            elif y == x - 1:
                gain, ids = m.unknown_score, [m.bytes[v] for v in w]
            else:
                continue
            if e not in best or best[s][0] + gain > best[e][0]:
                best[e] = (best[s][0] + gain, best[s][1] + ids)
    return best[len(b)][1]


def test_best_paths(pieces):
    rng = random.Random(2)
    segments = [unigram.MARKER + words(rng, 1) for _ in range(150)] + [unigram.MARKER * 5, "a" * 40, "\u65e5\u672c\u8a9e\U0001d518x", "\x00\n\t", unigram.MARKER + "------"]
    want = [brute_path(pieces, s) for s in segments]
    assert [x.tolist() for x in pieces.best(segments)] == want and all(pieces.best([s])[0].tolist() == w for s, w in zip(segments, want, strict=True))


def test_trie_matches_a_dictionary():
    rng = random.Random(4)
    items = {bytes(rng.choice(b"abcd\xff\x00") for _ in range(rng.randint(1, 6))): i for i in range(500)}
    t = unigram.Trie(items)
    data = np.array([rng.choice(b"abcd\xff\x00") for _ in range(300)])
    found = {(int(s), n, int(v)) for n, ss, vs in t.matches(data, np.arange(300), np.full(300, 300)) for s, v in zip(ss, vs, strict=True)}
    raw = bytes(data.tolist())
    assert found == {(s, n, items[raw[s : s + n]]) for s in range(300) for n in range(1, 7) if s + n <= 300 and raw[s : s + n] in items}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_file(path, pieces, rules, byte_fallback, extra=()):
    """A unigram model file of these pieces: (text, score, kind) besides; ``rules``: the normaliser's message."""
    score = np.array(pieces.score) / unigram.SCALE
    made = [(t, float(s), k) for t, s, k in zip(pieces.text, score, pieces.kind, strict=True) if byte_fallback or k != unigram.BYTE] + list(extra)
    body = b"".join(field(1, field(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for t, s, k in made)
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        trainer = next(v for n, _, v in unigram._fields(f.read()) if n == 2)
    new = {3: 1, 35: int(byte_fallback)}
    trainer = b"".join(varint(n << 3) + varint(new.get(n, v)) if w == 0 else field(n, v) if w == 2 else varint(n << 3 | w) + v for n, w, v in unigram._fields(trainer))
    path.write_bytes(body + field(2, trainer) + field(3, rules))
    return str(path)


ODD = ["  abc   def ", "abc\tdef\n\n x", "\ufb01ab \ufb03", "\uff26\uff55\uff4c\uff4c \uff11\u3000wide", "\U0001d518\u0e01\U0001f600 x \U0001d518", "\u00a8umlaut \u2460 \u00bd", "e\u0301 \u00e9 \u212b", "   ", "\u3000 \t", "\u2581a \u2581", "a<sep>b <sep> c", "zq wordle", "\u00ad\u200bsoft\ufeff", "x" * 300]


@pytest.mark.parametrize("name,byte_fallback", [("nmt_nfkc", True), ("nmt_nfkc", False), ("nfkc_cf", False), ("identity", True)])
def test_library_agrees_on_a_unigram_model(pieces, tmp_path, name, byte_fallback):
    """The library's own ids, on files with its normalisers, unused and user-defined pieces, with and without byte pieces."""
    import sentencepiece

    proto = sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    rules = next(v for n, _, v in unigram._fields(proto) if n == 3)
    if name == "identity":
        rules += varint(4 << 3) + varint(0)  # keep extra white space
    extra = [("<sep>", 0.0, unigram.USER_DEFINED), ("\u2581wordle", 0.0, unigram.UNUSED), ("zq", 5.0, unigram.UNUSED)]
    model = unigram_file(tmp_path / "u.model", pieces, rules, byte_fallback, extra)
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=model), unigram.Pieces(model)
    rng = random.Random(5)
    score = mine.score / unigram.SCALE
    plain = [words(rng, 8) for _ in range(100)]
    same = 0
    for text in plain + ODD:
        ids, theirs = mine.encode([text])[0].tolist(), lib.encode(text)
        assert mine.decode(ids) == lib.decode(ids) and mine.plain(text) == mine.decode(ids) or mine.unknown in ids, text
        # equal but for the library's 32-bit sums, which can settle a near tie the other way
        assert ids == theirs or abs(sum(score[i] for i in ids) - sum(score[i] for i in theirs)) < 1e-2, text
        same += ids == theirs
    assert same >= len(plain) + len(ODD) - 3
    assert mine.encode([None, ""]) [0].tolist() == [] == lib.encode("")


def test_files_that_are_not_supported_are_refused(pieces, tmp_path):
    for name, rules in (("spaces", varint(5 << 3) + varint(0)),):
        with pytest.raises(ValueError, match="white space"):
            unigram.Pieces(unigram_file(tmp_path / name, pieces, rules, True))
    with pytest.raises(ValueError, match="marker after another"):
        unigram.Pieces(unigram_file(tmp_path / "inner", pieces, b"", True, [("a\u2581b", -1.0, unigram.NORMAL)]))


def test_rows_without_ids_and_long_words(spark, pieces):
    d = spark.createDataFrame([(None, "a b"), (1, "x" * 200_000), (1, "x" * 200_000), (2, "\u65e5" * 50_000)], "doc_id long, text string")
    got = sorted(unigram.encoded(d, tokenizer_path("piece_bpe_32k.model")).collect(), key=lambda r: (r.doc_id or 0, r.n_pieces))
    assert [r.doc_id for r in got] == [None, 1, 1, 2] and got[1] == got[2] and all(r.round_trip for r in got)


def test_encoded_rows(spark, pieces):
    texts = sample() + ["a\u2581b", "  two  spaces ", "\x00 control"]
    got = {r.doc_id: r for r in unigram.encoded(docs(spark, texts), tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert r.round_trip and r.n_pieces == len(r.ids) and pieces.decode(r.ids) == (t or "").replace(unigram.MARKER, " ")
    assert got[texts.index(None)].ids == [] == got[texts.index("")].ids
    assert unigram.encoded(docs(spark, ["x"]).limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


# Pseudonyms


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PERSONAL = ["mail a.b-c@x1.example.com, card 4111 1111 1111 1111 or 4111111111111111.", "again a.b-c@x1.example.com 4111-1111-1111-1111", "bad 4111111111111112 x", "iban DE89370400440532013000 GB82 WEST 1234 5698 7654 32",
            "born 1999-12-31 and 31/12/1999, not 99/99/2000", "192.168.0.1 and 300.1.1.1", "123-45-6789 not 000-45-6789", "call +1 (521) 555-6210 now", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "3.5 percent of 1234567 in 2024, v1.2.3.4.5", None, ""]


def test_pseudonyms(spark):
    texts = PERSONAL
    rows = {r.doc_id: r for r in pii.pseudonymise(docs(spark, texts), report=True, key="k1").collect()}
    new = {i: r.text for i, r in rows.items()}
    kinds = {i: [x.kind for x in r.pii or []] for i, r in rows.items()}
    assert [kinds[i] for i in range(9)] == [["email", "card", "card"], ["email", "card"], [], ["iban", "iban"], ["date", "date"], ["ip"], ["ssn"], ["phone"], ["secret"]]
    assert new[2] == texts[2] and new[9] == texts[9] and new[10] is None and new[11] == ""
    assert all(len(new[i]) == len(t) for i, t in enumerate(texts) if t and i != 5)  # formats stay; parts of an address may be shorter
    cards = [re.sub("[ -]", "", x.new) for i in (0, 1) for x in rows[i].pii if x.kind == "card"]
    assert len(set(cards)) == 1 and luhn(cards[0]) and cards[0] != "4" + "1" * 15
    assert rows[0].pii[0].new == rows[1].pii[0].new != "a.b-c@x1.example.com"
    for x in rows[3].pii:
        t = x.new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    again = pii.pseudonymise(docs(spark, texts).coalesce(1), key="k1").select("doc_id", "text")
    assert {r.doc_id: r.text for r in again.collect()} == new
    other = {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, texts), key="k2").collect()}
    assert all(other[i] != new[i] for i in range(9) if i != 2)
    assert pii.pseudonymise(docs(spark, texts).limit(0)).count() == 0


def test_the_keys_holder_maps_back(spark):
    texts = [*PERSONAL, "at 2024-05-01T12:00:00Z and 2024-05-01Tx", "A.B@Mail.Example.ORG a.b@mail.example.org", "password: Zz9-abcdefghijklmnop_Q=", "12/31/1999 13.12.2001"]
    d = docs(spark, texts)
    there = pii.pseudonymise(d, key="k1")
    changed = {r.doc_id: r.text for r in there.collect()}
    assert {r.doc_id: r.text for r in pii.restored(there, key="k1").collect()} == dict(enumerate(texts))
    assert changed[12].endswith("T12:00:00Z and 2024-05-01Tx") and "2024-05-01T12" not in changed[12]
    a, b = changed[13].split()
    assert a.lower() == b and a != b and [c.isupper() for c in a] == [c.isupper() for c in texts[13].split()[0]]
    session = [r.text for r in pii.pseudonymise(d).orderBy("doc_id").collect()]  # without a key the session has one of its own
    assert session == [r.text for r in pii.pseudonymise(d).orderBy("doc_id").collect()] and session != [changed[i] for i in range(len(texts))]


def plain_rounds(key, left, right, shift):
    """The network in plain Python: ``shift(half, own, other, round)``."""
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = shift("l", left, right, i)
        else:
            right = shift("r", right, left, i)
    return left, right


def plain_residues(key, label, left, right, mods):
    number = lambda *p: int(hashlib.sha256("|".join([key, *map(str, p)]).encode()).hexdigest()[:15], 16)
    return plain_rounds(key, left, right, lambda half, own, other, i: (own + number(label, i, other)) % mods["lr".index(half)])


def plain_digits(key, kind, d):
    half = -(-len(d) // 2)
    a, b = plain_residues(key, f"{kind}{len(d)}", int(d[:half]), int(d[half:] or 0), (10**half, 10 ** (len(d) - half)))
    return f"{a:0{half}d}" + (f"{b:0{len(d) - half}d}" if len(d) > half else "")


def plain_characters(key, kind, text, classes):
    def shift(half, own, other, i):
        stream = "".join(hashlib.sha512(f"{key}|{kind}|{i}|{b}|{other.lower()}".encode()).hexdigest() for b in range(len(own) // 32 + 1))
        out = ""
        for at, c in enumerate(own):
            group = next((g for g in classes if c in g), None)
            out += group[(group.index(c) + int(stream[4 * at : 4 * at + 4], 16)) % len(group)] if group else c
        return out

    half = -(-len(text) // 2)
    return "".join(plain_rounds(key, text[:half], text[half:], shift))


def test_pseudonyms_against_plain_python(spark):
    import datetime

    rng = random.Random(6)
    low, up = string.ascii_lowercase, string.ascii_uppercase
    values = []
    for _ in range(60):
        card = "".join(rng.choices("0123456789", k=rng.randint(12, 18)))
        card += next(c for c in "0123456789" if luhn(card + c))
        body = plain_digits("k", "card", card[:-1])
        values.append((f"x {card} y", f"x {body}{next(c for c in '0123456789' if luhn(body + c))} y"))
        area, group, serial = rng.choice([1, 665, 667, 899, rng.randint(1, 665)]), rng.randint(1, 99), rng.randint(1, 9999)
        a, b = plain_residues("k", "ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, pii.SSN_FACTORS)
        n = a // 99 + 1
        values.append((f"{area:03d}-{group:02d}-{serial:04d}", f"{n + (n >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"))
        ip = [rng.randint(0, 255) for _ in range(4)]
        a, b = plain_residues("k", "ip", ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], (65536, 65536))
        values.append((".".join(map(str, ip)), f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"))
        phone = f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        new = iter(plain_digits("k", "phone", re.sub(r"\D", "", phone)))
        values.append((phone, re.sub(r"\d", lambda m: next(new), phone)))  # noqa: B023
        first, day = datetime.date(1800, 1, 1), datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(pii.CYCLE))
        a, b = plain_residues("k", "date", *divmod((day - first).days, pii.FACTORS[1]), pii.FACTORS)
        values.append((day.isoformat(), (first + datetime.timedelta(a * pii.FACTORS[1] + b)).isoformat()))
        head = "".join(rng.choices(low + up + string.digits, k=rng.randint(1, 40))) + "@" + "".join(rng.choices(low, k=rng.randint(1, 30)))
        values.append((f"<{head}.org>", f"<{plain_characters('k', 'email', head, (string.digits, low, up))}.org>"))
        token = "".join(rng.choices(low + up + string.digits + "_-", k=rng.randint(20, 120))) + "z"
        values.append((f"token={token};", f"token={plain_characters('k', 'secret', token, (string.digits, low[:6], low[6:], up[:6], up[6:]))};"))
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(v[0] for v in values)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()]
    assert [(v[0], g) for v, g in zip(values, got, strict=True)] == values


def test_permutations(spark):
    """Whole domains where they are small; stretches of the larger ones: no two values share a pseudonym, and all keep the format."""
    names = pii.Pseudonyms("k")
    for digits in (1, 2, 3):
        t = spark.range(10**digits).select(F.lpad(F.col("id").cast("string"), digits, "0").alias("d"))
        new = [r[0] for r in t.select(names.digits(F.col("d"), "t")).collect()]
        assert len(set(new)) == 10**digits and {len(x) for x in new} == {digits}
    days = spark.sql("select explode(sequence(date'1999-01-01', date'2004-12-31')) d")
    for form, pattern in (("yyyy-MM-dd", r"\d{4}-\d\d-\d\d"), ("dd/MM/yyyy", r"\d\d/\d\d/\d{4}"), ("MM/dd/yyyy", r"\d\d/\d\d/\d{4}")):
        new = [r[0] for r in days.select(names.date(F.date_format("d", form))).collect()]
        assert len(set(new)) == len(new) == 2192 and all(re.fullmatch(pattern, x) for x in new)
    a = spark.range(2000).select(F.concat(F.lit("10.7."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256).alias("ip"))
    new = [r[0] for r in a.select(names.ip(F.col("ip"))).collect()]
    assert len(set(new)) == 2000 and all(all(0 <= int(v) < 256 for v in x.split(".")) for x in new)
    letter = lambda n: F.chr(97 + (F.col("id") / n).cast("int") % 26)
    short = spark.range(26**3).select(F.concat(letter(1), letter(26), F.lit("@"), letter(676), F.lit(".com")).alias("v"))
    new = [r[0] for r in short.select(names.email(F.col("v"))).collect()]
    assert len(set(new)) == 26**3 and all(re.fullmatch(r"[a-z]{2}@[a-z]\.com", x) for x in new)
    numbers = spark.range(20_000).select(F.concat_ws("-", F.lpad((F.col("id") % 665 + 1).cast("string"), 3, "0"), F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 9999 + 1).cast("string"), 4, "0")).alias("v")).distinct()
    new = [r[0] for r in numbers.select(names.ssn(F.col("v"))).collect()]
    assert len(set(new)) == len(new) and all(re.fullmatch(pii.SSN, x) for x in new)


def test_pseudonyms_have_no_python_in_the_plan(spark):
    plan = pii.pseudonymise(docs(spark, ["x"], clash=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_text(spark):
    text = "word " * 300_000 + "4111111111111111 " + "x@y.example.com " + "1" * 100_000 + " a." * 50_000
    r = pii.pseudonymise(docs(spark, [text]), report=True).first()
    assert [x.kind for x in r.pii] == ["card", "email"] and len(r.text) == len(text)
    assert json.dumps(hashlib.sha256(r.text.encode()).hexdigest())
