"""What can go wrong, by kind."""


class Error(Exception):
    """Any error of this library."""


class InvalidModel(Error):
    """A model file is damaged or inconsistent."""


class UnsupportedModel(Error):
    """A model file is of a kind or version that is not supported."""


class ModelNotFound(Error):
    """There is no model of that name or path."""


class EncodingError(Error):
    """Bytes that are no UTF-8."""


class EmptyInput(Error):
    """A text without usable tokens, under the policy that refuses it."""


class ConversionError(Error):
    """A source cannot become a model."""


class InvalidSource(ConversionError):
    """A source lacks something or holds something unknown."""


class InvalidOption(Error, ValueError):
    """An argument is out of range."""
