"""Named queries; importing the package registers them."""

from pulseloom.plans import arrays, intervals, summaries, tests, waves  # noqa: F401
