"""Command of the external classifier. It runs on the driver's machine and only makes files; it is no query operator."""

from __future__ import annotations

import shlex
import subprocess
from pathlib import Path


def classifier_command(
    reads: list[str],
    db: str | None = None,
    report: str = "kraken_report.txt",
    output: str = "kraken_output.txt",
    classified_out: str | None = None,
    unclassified_out: str | None = None,
    odir: str = ".",
    program: str = "kraken2",
    threads: int = 1,
    extra: list[str] | None = None,
) -> list[str]:
    """Arguments for one or two files of reads (gzip told by extension), with minimizer columns in the report."""
    if not 1 <= len(reads) <= 2:
        raise ValueError("one file of reads, or two of pairs, are needed")
    inside = lambda name: str(Path(odir) / name)
    command = [program, "--threads", str(threads), "--report", inside(report), "--report-minimizer-data", "--output", inside(output)]
    if db is not None:
        command += ["--db", db]
    for option, name in (("--classified-out", classified_out), ("--unclassified-out", unclassified_out)):
        if name is not None:
            command += [option, inside(name)]
    if len(reads) == 2:
        command.append("--paired")
    if all(r.lower().endswith(".gz") for r in reads):
        command.append("--gzip-compressed")
    return [*command, *(extra or []), *reads]


def run_classifier(reads: list[str], env: str | None = None, conda: str | None = None, **options: object) -> subprocess.CompletedProcess:
    """Run the command, in the conda environment ``env`` if one is given; an exit code above 0 is an error."""
    Path(str(options.get("odir", "."))).mkdir(exist_ok=True)
    command = classifier_command(reads, **options)  # type: ignore[arg-type]
    if env is not None:
        command = [conda or "conda", "run", "-n", env, *command]
    print(shlex.join(command))
    return subprocess.run(command, check=True)
