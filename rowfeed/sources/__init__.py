"""Where rows come from: scans, row groups, generators, URLs."""
