"""Exceptions of the public API; ``code`` is the machine-readable error code."""


class LodestoneError(Exception):
    code = "INTERNAL_ERROR"


class IndexNotFound(LodestoneError):
    code = "INDEX_NOT_FOUND"


class IndexExists(LodestoneError):
    code = "INDEX_ALREADY_EXISTS"


class DocumentNotFound(LodestoneError):
    code = "DOCUMENT_NOT_FOUND"


class JobNotFound(LodestoneError):
    code = "JOB_NOT_FOUND"


class JobCancelled(LodestoneError):
    code = "JOB_CANCELLED"


class SameName(LodestoneError):
    code = "SAME_NAME"


class InvalidInput(LodestoneError):
    """``problems`` lists every failed rule."""

    code = "VALIDATION_FAILED"

    def __init__(self, problems: list[str] | str) -> None:
        self.problems = [problems] if isinstance(problems, str) else problems
        super().__init__("; ".join(self.problems))
