"""Exceptions of the engine."""


class DefinitionError(ValueError):
    """A request's parameter doesn't hold together."""


class EmptySubsetError(ValueError):
    """A subset has no rows."""


class UnitsError(ValueError):
    """Units are missing or can't be converted."""


class IncompleteSeasonError(ValueError):
    """A season's months can't be ordered."""


class BoundsPresentError(ValueError):
    """Bounds are there already."""


class RegridError(ValueError):
    """A field can't be regridded."""


class DimensionMapError(ValueError):
    """An axis has no column."""
