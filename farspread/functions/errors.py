"""The library's errors."""


class SpreadError(Exception):
    """Base of all errors that a user can mend."""


class DescriptorMismatchError(SpreadError):
    """Vectors of two feature spaces would be compared."""


class SpeciesError(SpreadError):
    """A record holds a species that the featurizer wasn't told of."""


class BoxError(SpreadError):
    """No cell can be built for a structure."""


class VacuumTooSmallError(BoxError):
    """The vacuum of a built cell is smaller than the cutoff needs."""


class FeatureTableError(SpreadError):
    """An external feature table doesn't fit the records."""


class ScanError(SpreadError):
    """A source can't be read."""
