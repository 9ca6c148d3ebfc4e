"""What can go wrong with a snapshot, its schema or its migrations."""

from __future__ import annotations


class SnapshotError(Exception):
    """Base of all errors raised here."""


class FormatError(SnapshotError):
    """A path does not hold a readable snapshot."""


class ConfigError(SnapshotError):
    """The project configuration names its schemas in a way that cannot work."""


class UnknownSignatureError(SnapshotError):
    def __init__(self, signature: str) -> None:
        self.signature = signature
        super().__init__(f'Unknown field signature "{signature}": a newer release or an unregistered field kind wrote it.')


def format_diff(diff: list) -> str:
    """One line a difference: + added, - removed, ~ changed, > moved."""
    lines = {
        "added": "  + {d.name} ({d.after})",
        "removed": "  - {d.name} ({d.before})",
        "changed": "  ~ {d.name}: {d.before} -> {d.after}",
        "moved": "  > {d.name}: position {d.before} -> {d.after}",
    }
    return "\n".join(lines[d.kind].format(d=d) for d in diff)


class SchemaMismatchError(SnapshotError):
    def __init__(self, expected: int, actual: int, diff: list, hint: str = "") -> None:
        self.expected, self.actual, self.diff = expected, actual, diff
        parts = [f"The snapshot's schema ({actual}) is not the one declared here ({expected}).", format_diff(diff), hint]
        super().__init__("\n".join(p for p in parts if p))


class MigrationPathError(SnapshotError):
    def __init__(self, start: int, end: int, detail: str) -> None:
        self.start, self.end, self.detail = start, end, detail
        super().__init__(f"No way from snapshot version {start} to {end}: {detail}")


class MigrationDataLossError(SnapshotError):
    def __init__(self, field: str, step: str, rows: int) -> None:
        self.field, self.step, self.rows = field, step, rows
        super().__init__(f'Step {step} would leave "{field}" empty, which had {rows} rows. Fill it in up(), or name it in drops.')


class CarryConflictError(SnapshotError):
    def __init__(self, field: str, step: str) -> None:
        self.field, self.step = field, step
        super().__init__(f'Step {step} wrote "{field}", which is carried over unchanged. Name it in rebuilds to replace it.')


def _of(name: str | None) -> str:
    return f' of schema "{name}"' if name else ""


class SchemaDriftError(SnapshotError):
    def __init__(self, expected: int, actual: int, diff: list, name: str | None = None) -> None:
        self.expected, self.actual, self.diff, self.name = expected, actual, diff, name
        body = format_diff(diff) or "  (same fields; only the recorded hash differs)"
        super().__init__(f"Changes{_of(name)} are in no migration:\n{body}\nRun: {generate_command(name)}")


class UnfinishedMigrationError(SnapshotError):
    def __init__(self, unfinished: list[tuple[str, list[str]]], name: str | None = None) -> None:
        self.unfinished, self.name = unfinished, name
        body = "\n".join(f"  {step}: {', '.join(fields)}" for step, fields in unfinished)
        super().__init__(f"Migrations{_of(name)} still hold placeholders:\n{body}\nFill in up() and take the names out of pending.")


class MissingMigrationsError(SnapshotError):
    def __init__(self, name: str | None = None) -> None:
        self.name = name
        super().__init__(f"No migrations{_of(name)} have been generated yet.\nRun: {generate_command(name)}")


def generate_command(name: str | None = None) -> str:
    return "python -m strataforge generate" + (f" --only {name}" if name else "")
