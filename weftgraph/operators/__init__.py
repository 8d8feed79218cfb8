"""Graph operators: functions from node, edge and hyperedge DataFrames to DataFrames."""
