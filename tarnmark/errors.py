"""Errors of loading and lookup."""

from __future__ import annotations

import warnings


class KnowledgeError(Exception):
    """Base of all errors here."""


class BundleNotFound(KnowledgeError):
    """The root is missing, or no directory; ``reason`` tells which."""

    def __init__(self, path: str, *, reason: str = "missing"):
        self.path, self.reason = path, reason
        what = "bundle path exists but is not a directory" if reason == "not_a_directory" else "bundle not found"
        super().__init__(f"{what}: {path}")


class BundleInvalid(KnowledgeError):
    """Files that failed, as path -> reason in path order."""

    def __init__(self, failed_files):
        pairs = failed_files.items() if isinstance(failed_files, dict) else ((p, "invalid concept file") for p in failed_files)
        self.failed_files = dict(sorted(pairs))
        n = len(self.failed_files)
        super().__init__(f"validation failed for {n} file{'s' * (n != 1)}: " + "; ".join(f"{p}: {r}" for p, r in self.failed_files.items()))


class ConceptNotFound(KnowledgeError):
    def __init__(self, concept_id: str):
        self.concept_id = concept_id
        super().__init__(f"Concept not found in bundle: {concept_id}")


class LinkUnresolved(KnowledgeError):
    """Never raised: links that lead nowhere stay rows with resolved = false."""

    def __init__(self, source_id: str, target: str):
        warnings.warn("unresolved links are rows, not errors", DeprecationWarning, stacklevel=2)
        self.source_id, self.target = source_id, target
        super().__init__(f"cannot resolve link {target!r} from concept {source_id!r}")


class StorageError(KnowledgeError):
    """The session names no folder that all executors share."""
