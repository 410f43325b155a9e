"""What callers may get wrong, and what may go wrong."""


class UsageError(ValueError):
    """Parameters that can't be served (exit code 2 of a command line)."""

    code = 2


class VaultError(RuntimeError):
    """A failure while serving right parameters (exit code 1)."""

    code = 1


#: The reasons that results carry in `error`, which callers read.
SAID = {
    "not readable": "not readable",
    "no changes": "Edit produced no changes",
    "not found": "replace text was not found",
    "no match": "regex did not match",
    "matched": "{} matched ",
    "times": " times; pass all to replace all",
    "line": "line {} is beyond end of file (",
    "range": "range end {} is beyond end of file (",
    "file": "Refusing to overwrite existing file: ",
    "path": "Refusing to overwrite existing path: ",
}


def positive(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 < value < 2**53:
        raise UsageError(f"{name} must be a positive integer")
    return value


def not_negative(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**53:
        raise UsageError(f"{name} must be zero or a positive integer")
    return value


def line_range(value: tuple[int, int], name: str) -> tuple[int, int]:
    start, end = positive(value[0], name), positive(value[1], name)
    if end < start:
        raise UsageError(f"{name} must not end before it starts")
    return start, end
