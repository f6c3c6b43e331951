"""DuckDB SQL for the catalog's queries, from named common table expressions."""

from __future__ import annotations

from strandloom.functions import codes

FROM, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


def quoted(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


def ctes(table: int = 11, min_length: int = 90, starts: tuple[str, ...] | None = None, stops: tuple[str, ...] | None = None) -> dict[str, str]:
    """The common table expressions, each on those before it."""
    starts, stops = starts or codes.starts(table), stops or codes.stops(table)
    amino = ", ".join(f"('{c}', '{a}')" for c, a in sorted(codes.amino_acids(table).items()))
    rank = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(starts))
    return {
        "scaffolds": f"SELECT doc_id AS scaffold_id, concat('doc_', doc_id) AS name, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{FROM}', '{TO}') AS sequence FROM documents WHERE text IS NOT NULL",
        "strands": "SELECT scaffold_id, '+' AS strand, sequence AS seq, length(sequence) AS host_len FROM scaffolds UNION ALL SELECT scaffold_id, '-', translate(reverse(sequence), 'ACGT', 'TGCA'), length(sequence) FROM scaffolds",
        "codons": "SELECT scaffold_id, strand, host_len, phase, phase + 3 * (i - 1) AS pos, codon FROM (SELECT scaffold_id, strand, host_len, phase, unnest(listed) AS codon, generate_subscripts(listed, 1) AS i FROM (SELECT *, regexp_extract_all(substr(seq, phase + 1), '...') AS listed FROM strands, (VALUES (0::BIGINT), (1), (2)) p(phase)))",
        "events": f"SELECT *, codon IN ({quoted(starts)}) AS is_start, codon NOT IN ({quoted(starts)}) AS is_stop, CASE codon {rank} ELSE -1 END AS start_type FROM codons WHERE codon IN ({quoted((*starts, *stops))})",
        "runs": "SELECT *, coalesce(sum(is_stop::INT) OVER (PARTITION BY scaffold_id, strand, phase ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM events",
        "groups": "SELECT scaffold_id, strand, phase, grp, any_value(host_len) AS host_len, min(pos) FILTER (is_start) AS longest, min(pos) FILTER (start_type = 0) AS atg, max(pos) FILTER (is_stop) AS stop, list(pos ORDER BY pos) FILTER (is_start) AS starts FROM runs GROUP BY ALL",
        "shaped": "SELECT *, CASE WHEN atg - longest <= 75 THEN atg ELSE longest END AS refined FROM groups",
        "placed": f"SELECT *, coalesce(stop + 3, host_len) AS \"end\", CASE WHEN longest IS NULL THEN phase WHEN coalesce(stop + 3, host_len) - refined >= {min_length} THEN refined ELSE longest END AS t_start FROM shaped WHERE longest IS NOT NULL OR (grp = 0 AND stop IS NOT NULL)",
        "orfs": f"SELECT scaffold_id, strand, phase, host_len, t_start, \"end\", CASE WHEN stop IS NULL THEN (\"end\" - t_start) - (\"end\" - t_start) % 3 ELSE \"end\" - t_start END AS len, longest IS NULL AS partial5, stop IS NULL AS partial3, starts FROM placed WHERE \"end\" - t_start >= {min_length}",
        "orfseqs": "SELECT o.*, substr(s.seq, o.t_start + 1, o.len) AS seq FROM orfs o JOIN strands s USING (scaffold_id, strand)",
        "genes": "SELECT *, len / (len + 300.0) AS score, CASE WHEN strand = '+' THEN t_start + 1 ELSE host_len - \"end\" + 1 END AS start, CASE WHEN strand = '+' THEN \"end\" ELSE host_len - t_start END AS stop, concat('doc_', scaffold_id) AS name FROM orfs WHERE len >= 300",
        "numbered": "SELECT *, row_number() OVER (ORDER BY name, stop, start, strand) AS ordinal FROM genes",
        "amino": f"SELECT * FROM (VALUES {amino}) t(codon, aa)",
    }


NEEDS = {
    "scaffolds": (), "strands": ("scaffolds",), "codons": ("strands",), "events": ("codons",), "runs": ("events",), "groups": ("runs",), "shaped": ("groups",), "placed": ("shaped",),
    "orfs": ("placed",), "orfseqs": ("orfs", "strands"), "genes": ("orfs",), "numbered": ("genes",), "amino": (),
}


#: Expressions that are made once and kept: they stand on both sides of joins, or so many steps lie behind them that no planner should estimate through them.
ONCE = {"scaffolds", "strands", "orfs", "orfseqs", "genes", "numbered", "amino", "binned", "pairs", "overprints", "proteins"}


def query(body: str, *names: str, more: dict[str, str] | None = None, once: bool = False, **options) -> str:
    """A SELECT with the expressions that it names, and ``more`` after them; ``once``: all are made once and kept."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    parts = ctes(**options)
    listed = [(n, parts[n]) for n in wanted] + list((more or {}).items())
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if once or n in ONCE else ''}({sql})" for n, sql in listed) + "\n" + body
