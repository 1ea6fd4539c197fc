"""The errors that checks raise."""


class DataValidationError(ValueError):
    pass


class DiscoveryError(ValueError):
    pass


class SubmissionError(ValueError):
    pass


class LabelConflictError(DataValidationError):
    pass


class NearDuplicateError(DataValidationError):
    pass


class ValidationFeasibilityError(ValueError):
    pass


class UnsupportedNormalizationError(ValueError):
    pass
