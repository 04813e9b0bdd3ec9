"""Files and tables into texts: see :mod:`docquarry.sources.tables`."""
