"""Stable error codes of the engine."""


class FieldtraceError(ValueError):
    """A refusal with a stable code, such as INVALID_POINTER."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
