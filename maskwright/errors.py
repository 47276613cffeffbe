"""Errors that a job reports."""


class PolicyError(ValueError):
    """A policy, manifest or request that can't be run."""


class SecretError(ValueError):
    """A secret that is missing or too weak."""


class FormatError(ValueError):
    """An input that isn't what its format says."""


class VaultError(ValueError):
    """A vault that can't be opened with this key, or was changed."""
