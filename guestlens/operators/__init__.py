"""guestlens.operators"""
