"""Conversation repair, Merkle manifest and packing against brute force."""
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mathtide.llm import conversations as C
from mathtide.llm import merkle, packing

# -- conversations ----------------------------------------------------------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spaced(v):
    return " " if v is None else str(v)


def brute_damage(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    found = defaultdict(list)
    for r in rows:
        own = found[r["conv_id"]]
        kind = zlib.crc32(f"{spaced(r['conv_id'])}:{spaced(r['turn'])}".encode()) % 20
        role, text = spaced(r["role"]), spaced(r["text"])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(r["turn"], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for own in found.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, sha(x[1] + "\0" + x[2])))
    return found


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else
                   "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The cheapest repair over every sequence of edits with up to two
    insertions at a place: what is cheaper than deleting all."""
    found = faults(rows)
    best = None

    def go(k, cost, audit, out, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows) and PATTERN.fullmatch("".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda x: x[:2])
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, cost + 5, audit + "I", out + [(role, "")], inserted + 1)
        if k < len(rows):
            _, role, text = rows[k]
            go(k + 1, cost + 2, audit + "D", out, 0)
            if found[k] not in ("blank", "duplicate"):
                extra = 5 if found[k] == "truncated" else 0
                go(k + 1, cost + extra, audit + "K", out + [(role, text)], 0)
                for new in ("user", "assistant"):
                    go(k + 1, cost + extra + 1, audit + "R", out + [(new, text)], 0)
    best = (2 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [], 0)
    return best[0], best[1], sha("\n".join(f"{r}:{t}" for r, t in best[2]))


def brute(rows):
    out = []
    for conv, own in brute_damage(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        kinds = faults(own)
        illegal = sum(a[1][:1] + b[1][:1] not in C.LEGAL for a, b in zip(own, own[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, *brute_repair(own)))
    return sorted(out, key=repr)


def test_repair_matches_brute_force(spark):
    rows, n = [], 0
    texts = ["Fine.", "Cut", "", None, "Fine."]
    for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=3):
        for shift in range(2):
            n += 1
            rows += [(n, k, role, texts[(n + k * (shift + 1)) % 5] if shift else f"Turn {k}.") for k, role in enumerate(roles)]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (900, None, "user", "a."), (900, 5, None, "b."),
             (900, 5, None, "b."), (900, 9, "", "c."), (901, 0, "user", None)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"g": F.lit(1), "n": F.lit("x"), "b": F.lit(2)})
    got = sorted(map(tuple, C.repair(C.damage(df)).collect()), key=repr)
    assert got == brute(df.collect())


def test_long_conversations_in_blocks(spark):
    rows = [(1, k, ("user", "assistant", "tool", "system")[k * k % 4 if k % 7 else 0], f"T{k % 40}" + "." * (k % 3))
            for k in range(700)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, TURNS)
    whole = C.repair(df, block=1000).collect()
    assert sorted(map(tuple, C.repair(df, block=4, fan=3).collect())) == sorted(map(tuple, whole))
    long = next(r for r in whole if r["conv_id"] == 1)
    assert len(long["audit"].replace("I", "")) == 700
    # the audit, carried out, gives the cost
    letters = {"K": 0, "R": 1, "D": 2, "I": 5}
    kinds, place, cost = faults([r[1:] for r in rows[:700]]), 0, 0
    for edit in long["audit"]:
        cost += letters[edit]
        if edit != "I":
            cost += 5 * (edit != "D" and kinds[place] == "truncated")
            place += 1
    assert cost == long["cost"]


def test_audits_of_equal_cost_are_no_prefixes():
    """What allows cells to hold one (cost, audit) each."""
    for letters in itertools.product("suaxSU1", repeat=3):
        for k, cell in enumerate(C.combine([C.turn_cells(x) for x in letters])):
            other = C.join(C.turn_cells(letters[0]), C.combine([C.turn_cells(x) for x in letters[1:]]))[k]
            assert cell == other


def test_repair_of_nothing(spark):
    assert C.repair(C.damage(spark.createDataFrame([], TURNS))).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = C.repair(C.damage(spark.createDataFrame([(dropped, 0, "user", "Hi.")], TURNS))).first()
    assert tuple(got) == (dropped, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_repair_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id < 40 and turn < 4")
    got = sorted(map(tuple, C.repair(C.damage(df)).collect()), key=repr)
    assert got == brute(df.collect())


# -- Merkle manifest --------------------------------------------------------------------------------------------------------

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha(field(r["doc_id"]) + field(r["source"]) + field(r["lang"]) + field(r["n_chars"]) + field(text))


def tree(leaves):
    """(top, path of every leaf) of a tree of fanout 3."""
    paths, members, nodes = [[] for _ in leaves], [[k] for k in range(len(leaves))], leaves
    while len(nodes) > 1:
        above, below = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k in range(len(run)):
                for m in members[at + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            below.append(sum(members[at:at + 3], []))
        nodes, members = above, below
    return nodes[0], paths


def brute_audit(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r["text"], r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for (_, _, digest, text, r), path in zip(by[s], trees[s][1]):
            path = path + upper[k]
            if text is not None and zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((r["doc_id"], digest, trees[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_audit_matches_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sorted(map(tuple, merkle.audit(df).collect()), key=repr)
    assert got == brute_audit(df.collect())
    assert 0 < sum(x[-1] for x in got) < len(got)


def test_audit_of_nasty_rows(nasty, empty):
    df = nasty.withColumn("path", F.lit("p")).withColumn("g", F.lit("q"))
    assert sorted(map(tuple, merkle.audit(df).collect()), key=repr) == brute_audit(df.collect())
    assert merkle.audit(empty).count() == 0


def test_manifest_tiers_do_not_matter(documents):
    rows = {merkle.manifest(documents, levels=n).agg(F.sum(F.xxhash64("doc_id", "path", "root").cast("decimal(38,0)"))
                                                     ).first()[0] for n in (1, 2, 5)}
    assert len(rows) == 1


def test_one_change_is_found(documents):
    was = merkle.manifest(documents).first()["root"]
    now = merkle.manifest(documents.withColumn("text", F.when(F.col("doc_id") == 7, "x").otherwise(F.col("text"))))
    assert now.first()["root"] != was


def test_levels_exchange_no_rows(spark, documents):
    """One exchange for all levels of a tier, whatever their number."""
    nodes = documents.select(F.col("source").alias("g"), F.col("doc_id").alias("i"), F.lit(200).cast("long").alias("n"),
                             F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("payload"))
    plan = merkle._tier(nodes, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# -- packing ----------------------------------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(df, rows, length=packing.LENGTH):
    """Every id of every document in exactly one piece, sequences gapless and
    not too long; the padding."""
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(VOCABULARY)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["place"]].append(r)
    want = sorted([(d["doc_id"], exact.encode(d["text"] or "", add_special_tokens=False).ids + [0]) for d in df.collect()],
                  key=repr)
    got = []
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == sum(x["length"] for x in own)
            at += r["length"]
        got.append((own[0]["doc_id"], [(r["length"], r["ids_crc32"]) for r in sorted(own, key=lambda r: r["start"])]))
    assert len(got) == len(want)
    cuts = defaultdict(list)
    for doc, ids in want:
        cuts[doc, len(ids)].append(ids)
    for doc, parts in got:
        own = cuts[doc, sum(n for n, _ in parts)]
        match = []
        for ids in own:
            at, same = 0, True
            for n, crc in parts:
                same &= zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:at + n])) == crc
                at += n
            match.append(same)
        assert any(match)
        own.pop(match.index(True))
    fills = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills[r["sequence_id"]]
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values(), default=0) <= length
    return sum(0 if packing.full(n, length) else length - n for n in fills.values())


def test_packing_is_exact(documents):
    rows = packing.pack(documents, VOCABULARY).collect()
    assert check_packing(documents, rows) < packing.LENGTH          # one open sequence at most


def test_packing_in_groups(documents_mid):
    rows = packing.pack(documents_mid, VOCABULARY, group=100).collect()
    assert check_packing(documents_mid, rows) < 30 * packing.LENGTH
    assert len({r["sequence_id"] >> 32 for r in rows}) == 10


def test_packing_without_cuts(documents_mid):
    rows = packing.pack(documents_mid, VOCABULARY, top_up=False).collect()
    waste = check_packing(documents_mid, rows)
    assert waste < 0.05 * sum(r["length"] for r in rows)
    tails = [r for r in rows if r["start"] + r["length"] == r["doc_tokens"] and r["length"] < packing.LENGTH]
    assert all(r["start"] % packing.LENGTH == 0 for r in tails)


def test_packing_of_nasty_rows(spark, nasty, empty):
    special = spark.createDataFrame([(9, "a <|endoftext|> b", "en", "a", 17)], "doc_id long, text string, lang string, "
                                    "source string, n_chars long")
    df = nasty.select("doc_id", "text", "lang", "source", "n_chars").union(special).withColumn("g", F.lit("x"))
    check_packing(df, packing.pack(df, VOCABULARY).collect())
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_first_fit_decreasing_by_definition():
    import random
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 100):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        plain = []
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            at = next((b for b in plain if sum(sizes[j] for j in b) + sizes[k] <= 100), None)
            if at is None:
                plain.append([k])
            else:
                at.append(k)
        assert packing.first_fit_decreasing(sizes, 100) == plain
