"""Operators over texts: encoding, packing, residue detection."""
