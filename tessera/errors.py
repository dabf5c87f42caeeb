"""Exceptions and warnings of the engine."""


class EngineError(Exception):
    """Base of everything that the engine raises on purpose."""


class ConfigError(EngineError):
    """A parameter, name or input that the engine cannot work with."""


class ParseError(ConfigError):
    """Factor text or JSON outside the language."""


class LookAheadDetected(EngineError):
    """A factor uses the future."""


class DataSchemaViolation(EngineError):
    """Rows that break their table's schema."""


class DuplicateFactor(EngineError):
    """A factor that the ledger holds already."""


class DuplicateCheckSaturated(EngineError):
    """The duplicate check met its cap before a verdict."""


class CostModelSaturation(UserWarning):
    """An order so large that slippage is at its ceiling."""
