"""Column functions over nucleotide strings.  Everything here stays in the JVM.

Positions are 0-based unless stated; sequences are read through their binary
form, where taking a slice costs its own length only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complement tables for the two treatments of the unknown base.
FROM_BASES = "ACGTNacgtn"
COMPLEMENT_N_AS_A = "TGCAATGCAA"
COMPLEMENT_N_AS_N = "TGCANTGCAN"
STOP_CODONS = ("TAG", "TAA", "TGA")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _n(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def piece(seq, start, length) -> Column:
    """``length`` bases from the 0-based ``start``."""
    raw = _col(seq).cast("binary")
    return F.substring(raw, (_n(start) + 1).cast("int"), _n(length).cast("int")).cast("string")


def indices(count) -> Column:
    """``0 .. count-1``, empty when ``count <= 0``."""
    n = _n(count).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def bound(body, **values) -> Column:
    """Evaluate ``values`` once and hand them to ``body`` as fields of one variable.

    Inside a lambda a plain column would be computed again for every element.
    """
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(one, body), F.lit(0))


def _raw(c) -> Column:
    return _col(c).cast("binary")


def _at(raw, i) -> Column:
    """One base of a binary sequence at the 0-based ``i``."""
    return F.substring(raw, i + 1, F.lit(1))


def _cut(raw, start, length) -> Column:
    return F.substring(raw, start + 1, _n(length))


# -- complements -------------------------------------------------------------

def complement(seq, keep_n: bool = True) -> Column:
    return F.translate(_col(seq), FROM_BASES, COMPLEMENT_N_AS_N if keep_n else COMPLEMENT_N_AS_A)


def reverse_complement(seq, keep_n: bool = True) -> Column:
    """Reverse complement in upper case; the unknown base stays N or becomes A."""
    return F.reverse(complement(seq, keep_n))


# -- distances ---------------------------------------------------------------

def mismatches(s1, start1, s2, start2, length) -> Column:
    """Number of differing bases in two windows of the same length."""
    def count(v):
        differ = lambda acc, i: acc + F.when(_at(v["a"], i) != _at(v["b"], i), 1).otherwise(0)
        return F.aggregate(v["i"], F.lit(0), differ)
    return bound(count, a=_raw(piece(s1, start1, length)), b=_raw(piece(s2, start2, length)), i=indices(length))


def hamming(s1, s2) -> Column:
    """Hamming distance; sequences of unequal length are an error."""
    a, b = _col(s1), _col(s2)
    checked = F.when(F.length(a) == F.length(b), F.length(a)).otherwise(
        F.raise_error(F.lit("hamming needs equal lengths")).cast("int"))
    return mismatches(a, 0, b, 0, checked)


def hamming_shorter(s1, s2) -> Column:
    """Hamming distance over the length of the shorter sequence."""
    a, b = _col(s1), _col(s2)
    return mismatches(a, 0, b, 0, F.least(F.length(a), F.length(b)))


def differing_positions(s1, s2) -> Column:
    n = F.least(F.length(_col(s1)), F.length(_col(s2)))
    return bound(lambda v: F.filter(v["i"], lambda i: _at(v["a"], i) != _at(v["b"], i)), a=_raw(s1), b=_raw(s2), i=indices(n))


def overlap_length(s1, start1, s2, start2) -> Column:
    return F.least(F.length(_col(s1)) - _n(start1), F.length(_col(s2)) - _n(start2))


def bounded_mismatches(s1, start1, s2, start2, max_errors) -> Column:
    """Mismatches of the overlap, or the overlap length once ``max_errors`` is exceeded."""
    n = overlap_length(s1, start1, s2, start2)
    m = mismatches(s1, start1, s2, start2, n)
    return F.when(m > _n(max_errors), n).otherwise(m)


def penalised_overlap(s1, start1, s2, start2, max_errors, penalty) -> Column:
    """Overlap length minus ``penalty`` per mismatch; 0 when over a limit or negative."""
    n = overlap_length(s1, start1, s2, start2)
    m = mismatches(s1, start1, s2, start2, n)
    return F.when((m > _n(max_errors)) | (n < m * _n(penalty)), 0).otherwise(n - m * _n(penalty))


def overlap_score(s1, start1, s2, start2, match: int = 1, penalty: int = 5) -> Column:
    """``match`` per equal base minus ``penalty`` per mismatch over the true overlap."""
    n = overlap_length(s1, start1, s2, start2)
    m = mismatches(s1, start1, s2, start2, n)
    return (n - m) * match - m * penalty


# -- overlaps ----------------------------------------------------------------

def superstring(s1, start1, s2, start2) -> Column:
    """Union of two sequences that overlap with ``s1[start1] ~ s2[start2]``."""
    a, b = _col(s1), _col(s2)
    n = overlap_length(a, start1, b, start2)
    one = F.concat(piece(a, 0, _n(start1) + n), piece(b, _n(start2) + n, F.length(b)))
    two = F.concat(piece(b, 0, _n(start2) + n), piece(a, _n(start1) + n, F.length(a)))
    return F.when(_n(start1) > _n(start2), one).otherwise(two)


def merge_with_overlap(parts, k) -> Column:
    """Join an ordered array of sequences that overlap by ``k`` bases each."""
    arr = _col(parts)
    return F.aggregate(F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0))), F.element_at(arr, 1),
                       lambda acc, nxt: F.concat(acc, piece(nxt, k, F.length(nxt))))


def similar_to_right(s1, s2, k: int) -> Column:
    """True when some suffix of ``s1`` of at least ``k`` bases starts ``s2``."""
    n1, n2 = F.length(_col(s1)), F.length(_col(s2))
    fits = lambda v: F.exists(v["i"], lambda i: (v["n2"] >= v["n1"] - i) & F.startswith(v["b"], _cut(v["a"], i, v["n1"])))
    return bound(fits, a=_raw(s1), b=_raw(s2), n1=n1, n2=n2, i=indices(n1 - k + 1))


def similar_to_left(s1, s2, k: int) -> Column:
    return similar_to_right(s2, s1, k)


# -- k-mers ------------------------------------------------------------------

def kmers(seq, k: int) -> Column:
    """All k-mers in order; empty when the sequence is shorter than ``k``."""
    every = lambda v: F.transform(v["i"], lambda i: _cut(v["s"], i, k).cast("string"))
    return bound(every, s=_raw(seq), i=indices(F.length(_col(seq)) - k + 1))


def kmer_shift_left(kmer, base) -> Column:
    """Drop the first base and append ``base``."""
    s = _col(kmer)
    return F.concat(piece(s, 1, F.length(s)), _n(base))


def kmer_shift_right(kmer, base) -> Column:
    """Drop the last base and put ``base`` in front."""
    s = _col(kmer)
    return F.concat(_n(base), piece(s, 0, F.length(s) - 1))


def kmer_start(kmer) -> Column:
    return piece(kmer, 0, F.length(_col(kmer)) - 1)


def kmer_end(kmer) -> Column:
    return piece(kmer, 1, F.length(_col(kmer)))


def first_valid_kmer(seq, k: int, start: int = 0) -> Column:
    """0-based start of the first window of ``k`` plain bases at or after ``start``; NULL if none."""
    at = F.regexp_instr(piece(seq, start, F.length(_col(seq))), F.lit(f"[ACGTacgt]{{{k}}}"))
    return F.when(at > 0, at - 1 + start)


def good_positions(seq, quality, threshold: int, offset: int = 33) -> Column:
    """0-based positions of known bases whose quality exceeds ``threshold``."""
    unknown = F.lit("N").cast("binary")
    fine = lambda v: F.filter(v["i"], lambda i: (_at(v["s"], i) != unknown) & (
        F.ascii(_at(v["q"], i).cast("string")) - offset > threshold))
    return bound(fine, s=_raw(seq), q=_raw(quality), i=indices(F.length(_col(seq))))


# -- validity ----------------------------------------------------------------

def is_valid(seq, accept_empty: bool = False) -> Column:
    """True for plain ACGT text.  The two readers differ on empty sequences."""
    return F.rlike(_col(seq), F.lit("^[ACGTacgt]*$" if accept_empty else "^[ACGTacgt]+$"))


def valid_runs(seq) -> Column:
    """All maximal runs of plain bases, in order."""
    return F.filter(F.split(_col(seq), "[^ACGTacgt]+"), lambda x: x != "")


def longest_valid_run(seq) -> Column:
    """Longest run of plain bases, the leftmost among equals; empty when none."""
    return F.aggregate(valid_runs(seq), F.lit(""),
                       lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def stop_codon_position(seq, frame: int) -> Column:
    """Position of the first stop codon of a frame after its first codon.

    The last codon looked at starts before ``length - 3``; the sequence length
    stands for "none".
    """
    n = F.length(_col(seq))
    last = F.floor((n - 3 - frame) / 3).cast("int")
    starts = F.transform(indices(last - 1), lambda i: (i + 1) * 3 + frame)
    stops = lambda v: F.filter(v["p"], lambda p: _cut(v["s"], p, 3).cast("string").isin(*STOP_CODONS))
    return F.coalesce(F.array_min(bound(stops, s=_raw(seq), p=starts)), n)


def has_stop_codon_in_all_frames(seq) -> Column:
    n = F.length(_col(seq))
    return ((stop_codon_position(seq, 0) < n) & (stop_codon_position(seq, 1) < n)
            & (stop_codon_position(seq, 2) < n))


# -- aligned pairs -----------------------------------------------------------

def alignment_symbols(s1, s2) -> Column:
    """Per column of two aligned rows: ``.`` equal, ``!`` gap, ``_`` mismatch."""
    n = F.least(F.length(_col(s1)), F.length(_col(s2)))
    gap = F.lit("-").cast("binary")
    mark = lambda v: lambda i: F.when(_at(v["a"], i) == _at(v["b"], i), ".").when(
        (_at(v["a"], i) == gap) | (_at(v["b"], i) == gap), "!").otherwise("_")
    return F.array_join(bound(lambda v: F.transform(v["i"], mark(v)), a=_raw(s1), b=_raw(s2), i=indices(n)), "")


def gap_free(symbols) -> Column:
    return ~F.contains(_col(symbols), F.lit("!"))


def mismatch_count(symbols) -> Column:
    s = _col(symbols)
    return F.length(s) - F.length(F.translate(s, "_", ""))


def relative_mismatch_positions(symbols) -> Column:
    """``i / length`` for every mismatch column."""
    n = F.length(_col(symbols))
    miss = F.lit("_").cast("binary")
    at = bound(lambda v: F.filter(v["i"], lambda i: _at(v["s"], i) == miss), s=_raw(symbols), i=indices(n))
    return F.transform(at, lambda i: i / n)


# -- names, numbers, text ----------------------------------------------------

def underscored(name) -> Column:
    return F.translate(_col(name), " ", "_")


def token(text, separator: str, index: int) -> Column:
    """0-based field of a separated string; NULL when missing."""
    return F.try_element_at(F.split(_col(text), separator), F.lit(index + 1))


def number_range(text) -> Column:
    """``a..b`` as ``struct(lo, hi)``."""
    t = _col(text)
    return F.struct(F.substring_index(t, "..", 1).cast("long").alias("lo"),
                    F.substring_index(t, "..", -1).cast("long").alias("hi"))


def file_extension(path) -> Column:
    return F.regexp_extract(_col(path), r"\.([^./]*)$", 1)


def file_basename(path) -> Column:
    return F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def map_position_uniform(position, upper, lower) -> Column:
    """Scale a 0-based position between two lengths, symmetric around the middle."""
    p, a, b = _n(position), _n(upper), _n(lower)
    scaled = lambda q: F.call_function("div", (2 * q + 1) * b, 2 * a)
    return F.when(p * 2 + 1 >= a, scaled(p)).otherwise(b - 1 - scaled(a - 1 - p))


def map_position_keeping_ends(position, upper, lower) -> Column:
    """Scale a 0-based position between two lengths, rounding half up."""
    p, a, b = _n(position), _n(upper), _n(lower)
    return F.when(b == 1, F.lit(0)).otherwise(F.call_function("div", 2 * p * b + a, 2 * a))


def nearly_equal(a, b, tolerance: float = 1e-12) -> Column:
    x, y = _n(a), _n(b)
    return F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))


def clearly_less(a, b, tolerance: float = 1e-12) -> Column:
    return (_n(a) < _n(b)) & ~nearly_equal(a, b, tolerance)


def tolerant_floor(x, tolerance: float = 1e-9) -> Column:
    return F.floor(_n(x) + tolerance)


def tolerant_round(x, tolerance: float = 1e-9) -> Column:
    return F.floor(_n(x) + 0.5 + tolerance)


def tolerant_towards_zero(x, tolerance: float = 1e-9) -> Column:
    v = _n(x)
    return F.when(v >= 0, F.floor(v + tolerance)).otherwise(F.ceil(v - tolerance))


def share_bucket(rate) -> Column:
    """Slot 0..5 of a share rate in 50%..100%."""
    return F.floor(_n(rate).cast("double") * F.lit(10.0)) - 5
