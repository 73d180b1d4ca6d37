"""Which optional packages are the real ones."""

import importlib.util

HAS_NETCDF = "stubs" not in str(getattr(importlib.util.find_spec("netCDF4"), "origin", ""))
