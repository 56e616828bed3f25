"""A small genome with inserted elements and paired reads of it, for end-to-end tests."""

import random
from pathlib import Path


def revcomp(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def simulate(folder: Path, sites: int = 8, genome_size: int = 60_000, depth: int = 20, read: int = 100, insert: int = 400, seed: int = 3, errors: float = 0, indels: int = 0, resident: int = 0) -> list[tuple[str, int, int, str]]:
    """Write te.fa, genome.fa, r1.fq, r2.fq; gives the true sites (chrom, start, end of the duplication, element).

    ``errors``: part of the bases that are read wrongly. ``indels``: insertions and deletions of up to nine bases between
    the genome and the sample, away from the sites. ``resident``: copies of the elements that both have, listed in genome.out.
    """
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    elements = {"hopA": dna(430), "hopB": dna(700)}
    genome = dna(genome_size)
    annotated = []
    for i in range(resident):  # between the sites, at thirds of their distance
        at, copy = int((i * max(1, sites // resident) + 0.97) * genome_size / sites), elements[rng.choice(sorted(elements))]
        annotated.append((at, next(n for n, e in elements.items() if e == copy), len(copy), "+" if i % 2 else "C"))
        copy = copy if i % 2 else revcomp(copy)
        genome = genome[:at] + copy + genome[at + len(copy) :]
    places = [int((i + 0.5) * genome_size / sites) + rng.randrange(-500, 500) for i in range(sites)]
    sample, truth, last = "", [], 0

    def mutated(piece: str) -> str:
        """The genome between two sites, with its share of the indels at least 150 bases from both."""
        for _ in range(indels // sites if len(piece) > 400 else 0):
            at, size = rng.randrange(150, len(piece) - 160), rng.randrange(1, 10)
            piece = piece[:at] + (dna(size) + piece[at:] if rng.random() < 0.5 else piece[at + size :])
        return piece

    def as_read(bases: str) -> str:
        return "".join(rng.choice("ACGT") if rng.random() < errors else c for c in bases) if errors else bases

    for i, p in enumerate(places):  # the duplicated bases end at p
        name, size = rng.choice(sorted(elements)), rng.choice((3, 5))
        sample += mutated(genome[last:p]) + (elements[name] if i % 2 == 0 else revcomp(elements[name]))
        last = p - size
        truth.append(("chr1", p - size + 1, p, name))
    sample += genome[last:]
    pairs = []
    for i in range(len(sample) * depth // (2 * read)):
        a = rng.randrange(0, len(sample) - insert)
        one, two = sample[a : a + read], revcomp(sample[a + insert - read : a + insert])
        one, two = as_read(one), as_read(two)
        pairs.append((f"read_{i}", *((one, two) if rng.random() < 0.5 else (two, one))))
    (folder / "te.fa").write_text("".join(f">{n} element\n{s}\n" for n, s in elements.items()))
    (folder / "genome.fa").write_text(">chr1\n" + "\n".join(genome[i : i + 70] for i in range(0, len(genome), 70)) + "\n")
    head = "   SW   perc perc perc  query\nscore   div. del. ins.  sequence\n\n"
    lines = [f"  2000  0.0 0.0 0.0 chr1 {at + 1} {at + n} (0) {strand} {name} DNA/x 1 {n} (0) {i}" for i, (at, name, n, strand) in enumerate(annotated)]
    (folder / "genome.out").write_text(head + "".join(x + "\n" for x in lines))
    for mate in (1, 2):
        (folder / f"r{mate}.fq").write_text("".join(f"@{x[0]}/{mate}\n{x[mate]}\n+\n{'I' * read}\n" for x in pairs))
    return truth
