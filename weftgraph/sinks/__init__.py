"""Writers of graphs: scripts, markup, notes, reports and versioned snapshots."""
