"""Reports: each is a function (tables, params, settings) -> DataFrame."""
