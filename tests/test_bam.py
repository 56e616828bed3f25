"""BAM files of many sizes of splits, written here by the format's public description."""

import random
import struct
import zlib

from hoptrace.sources.bam import BASES, OPERATIONS, read_bam
from hoptrace.sources.sam import genome_reads


def blocks(data, size):
    out = b""
    for a in range(0, len(data), size):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data[a : a + size]) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[a : a + size]), len(data[a : a + size]))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def write(path, refs, rows, size=5000):
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, n in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for name, flag, ref, pos, ops, seq, qual, tags in rows:
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | OPERATIONS.index(o)) for n, o in ops)
        codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)) + tags
        data += struct.pack("<i", len(body)) + body
    path.write_bytes(blocks(data, size))


def test_splits(spark, tmp_path):
    rng = random.Random(1)
    refs, rows, want = [("c1", 100_000), ("c2", 5000)], [], []
    for i in range(3000):
        n = rng.randrange(0, 150)
        seq, ref = "".join(rng.choices("ACGTN", k=n)), rng.choice([0, 0, 1, -1])
        qual = "".join(chr(rng.randrange(33, 74)) for _ in range(n)) if rng.random() < 0.8 and n else ""
        ops = [(n, "M"), (3, "D")] if n and ref >= 0 else []
        nm = rng.choice([None, 0, 3])
        tags = b"XZZabc\0XBBc\3\0\0\0\1\2\3" + (b"" if nm is None else b"NMC" + bytes([nm])) + b"XAAq"
        pos = rng.randrange(0, 4000) if ref >= 0 else -1
        rows.append((f"read{i}", 0 if ref >= 0 else 4, ref, pos, ops, seq, qual, tags))
        want.append((f"read{i}", 0 if ref >= 0 else 4, ref if ref >= 0 else None, refs[ref][0] if ref >= 0 else None, refs[ref][1] if ref >= 0 else None, pos if ref >= 0 else None,
                     f"{n}M3D" if ops else None, pos + n + 3 if ops else None, seq or "*", qual or None, nm))
    write(tmp_path / "a.bam", refs, rows)
    for size in (1 << 26, 20_000, 3001):
        got = read_bam(spark, str(tmp_path / "a.bam"), size).orderBy("ordinal").drop("ordinal").collect()
        assert [tuple(r) for r in got] == want
    assert genome_reads(read_bam(spark, str(tmp_path / "a.bam"))).count() == sum(w[7] is not None for w in want)


def test_empty(spark, tmp_path):
    write(tmp_path / "b.bam", [("c", 9)], [])
    assert read_bam(spark, str(tmp_path / "b.bam")).count() == 0
