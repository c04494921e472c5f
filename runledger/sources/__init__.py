"""Where rows come from and go to: trace logs, state documents, captured runs, status text, source texts, settings."""
